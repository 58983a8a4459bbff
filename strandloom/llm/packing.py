"""Mixture-controlled packing: deficit round-robin over source queues.

Documents become token ids once, in a table in the shared folder. A token's weight follows its source: each
window of sequence_tokens gets a quantum of every source's target share, sources with a positive deficit are
served chunk by chunk, and what a source got above or below its share is carried to the next window. Rows are
dealt to blocks by hash; a block's first token and the deficits it starts with are running sums over blocks
and sources, a table that is joined to the rows, so blocks are packed independently and still form one gapless
stream: only the last sequence of all can have padding. Copies of a row (a mixture reads some documents more
than once) stand evenly apart in their block, never next to each other.
"""

from __future__ import annotations

import os
import zlib
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .util import batch_bytes, documents, freed, pieces, stored, text_column

SEQUENCE, CHUNK, END = 2048, 512, 1
#: Tokens of a block, about; a block is packed by one task.
BLOCK_TOKENS = 1 << 20
#: Blocks of a stretch: running sums are made within stretches first, then over the stretches' sums.
STRETCH = 4096
#: Equal rows up to this many share a block; more of them are dealt to several.
COPIES = 256


#: Texts that show whether a tokenizer treats units alone as it treats them in a text.
PROBES = ["It's 10:30 -- don't PANIC, McDonald's e-mail: a.b@c.org!", "x=1;y==20 <|endoftext|> \u00e9t\u00e9 ... stra\u00dfe\n\n  2,000.50%", "Hello HELLO hello", "a\tb\u00a0c \u4e2d\u6587 1a2b", ""]


class Units:
    """Token ids of the units that texts are made of, each encoded once per worker.

    Text is cut at ASCII white space; a cut piece of plain ASCII without ' or < is cut further into runs of
    letters, single digits and runs of other signs, as the tokenizer's own first step does. Other pieces are
    encoded whole. The memory is emptied when it holds `most` units. A tokenizer for which these cuts change
    the ids (another vocabulary's first step, one that tells upper from lower case) is used on whole texts.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.encode_special_tokens = True
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.clear()
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.whole = False
        try:
            ids, bounds = self(pa.array(PROBES))
            self.whole = any(ids[a:b].tolist() != self.plain(x) for x, a, b in zip(PROBES, bounds[:-1], bounds[1:]))
        except ValueError:
            self.whole = True
        self.clear()

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units in a row, and how many each has.

        White space separates units for the tokenizer, so many are encoded as one text with the digit 0, which
        is always a token of its own, between them; units that have a 0 themselves are encoded one by one.
        """
        mark = self.tokenizer.token_to_id("0</w>")
        # 0: ASCII letters, for which lower case and the model suffice; 1: others; 2: with a 0
        kind = np.fromiter((0 if x.isascii() and x.isalpha() else 1 if "0" not in x else 2 for x in texts), np.int8, len(texts))
        sizes, flats = np.zeros(len(texts), np.int64), {}
        for k, tokenizer in ((0, self.bare), (1, self.tokenizer)):
            joined = [x for x, own in zip(texts, kind) if own == k]
            groups = [" 0 ".join(joined[i : i + 500]) + " 0" for i in range(0, len(joined), 500)]
            ids = [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast([x.lower() for x in groups] if k == 0 else groups, add_special_tokens=False)]
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            marks = np.flatnonzero(flat == mark)
            if len(marks) != len(joined):
                raise ValueError("a unit without the sign 0 has its token")
            sizes[kind == k], flats[k] = np.diff(np.concatenate([[-1], marks])) - 1, flat[flat != mark]
        alone = [x.ids for x in self.tokenizer.encode_batch_fast([x for x, own in zip(texts, kind) if own == 2], add_special_tokens=False)]
        sizes[kind == 2], flats[2] = [len(x) for x in alone], np.array([x for y in alone for x in y], np.uint32)
        out = np.zeros(int(sizes.sum()), np.uint32)
        starts = np.cumsum(sizes) - sizes
        for k, flat in flats.items():
            out[K.ragged(starts[kind == k], sizes[kind == k])] = flat
        return out, sizes

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.keys) + len(keys) > self.most:
            self.clear()
        flat, sizes = self.encode(texts)
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids, self.starts, self.sizes = np.concatenate([self.ids, flat]), np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes.astype(np.int32)])
        merged = np.concatenate([self.keys, keys])
        at = np.concatenate([self.at, np.arange(len(self.at), len(self.at) + len(keys), dtype=np.int32)])
        order = np.argsort(merged, kind="stable")
        self.keys, self.at = merged[order], at[order]

    def known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        found = self.keys[where] == keys if len(self.keys) else np.zeros(len(keys), bool)
        return where, found

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids start (one entry more than texts)."""
        if self.whole:
            rows = [self.plain(x or "") for x in column.to_pylist()]
            return np.array([i for x in rows for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in rows], dtype=np.int64)])
        data, bounds = K.utf8(column)
        starts, ends = units(data, bounds)
        first = np.searchsorted(starts, bounds, side="left")
        keys = K.span_hashes(K.LOWER[data], starts, ends)
        distinct, place, inverse = np.unique(keys, return_index=True, return_inverse=True)
        _, found = self.known(distinct)
        if not found.all():
            if len(self.keys) + int((~found).sum()) > self.most:
                self.clear()
                found[:] = False
            raw, new = data.tobytes(), np.flatnonzero(~found)
            self.learn(distinct[new], [raw[starts[i] : ends[i]].decode() for i in place[new]])
        where, _ = self.known(distinct)
        at = self.at[where][inverse] if len(distinct) else np.zeros(0, np.int64)
        sizes = self.sizes[at].astype(np.int64)
        ids = self.ids[K.ragged(self.starts[at], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[first]


#: 0 white space, 1 letter, 2 digit, 3 another sign.
_KIND = np.full(256, 3, np.uint8)
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[K.SPACE] = 0
#: Bytes that make a piece be encoded whole: beyond ASCII, control signs, ' and <.
_WHOLE = np.zeros(256, np.uint8)
_WHOLE[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x27, 0x3C, *range(0x7F, 0x100)]] = 1


def units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units of all texts."""
    kind = _KIND[data]
    starts, ends = K.runs(kind != 0, bounds)
    if not len(starts):
        return starts, ends
    whole = np.bitwise_or.reduceat(_WHOLE[data], starts) > 0
    cut = np.zeros(len(data), bool)
    cut[1:] = (kind[1:] != kind[:-1]) & (kind[1:] != 0)
    cut |= kind == 2
    cut[starts] = True
    first = np.zeros(len(data), bool)
    first[starts] = True
    begin = np.flatnonzero(cut)
    heads = first[begin]
    piece = np.cumsum(heads) - 1
    stay = heads | ~whole[piece]
    begin, piece = begin[stay], piece[stay]
    return begin, np.minimum(np.append(begin[1:], len(data)), ends[piece])


_units: dict[str, Units] = {}


def tokens(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """df's columns (without the text) with n_tokens and ids: little-endian unsigned ids of 16 bits (32 for a
    vocabulary beyond 65,536), the end id last.

    A null text counts as empty and has the end id alone.
    """
    others = [f for f in df.schema.fields if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", n_tokens long, ids binary"

    def encode(batches):
        freed()
        if tokenizer not in _units:
            _units[tokenizer] = Units(tokenizer)
        kind = "<u4" if _units[tokenizer].wide else "<u2"
        end = np.array([END], kind).tobytes()
        for batch in pieces(batches, text, 1 << 20):
            ids, bounds = _units[tokenizer](batch.column(text))
            ids = ids.astype(kind)
            rows = [ids[a:b].tobytes() + end for a, b in zip(bounds[:-1], bounds[1:])]
            columns = [batch.column(f.name) for f in others] + [pa.array(np.diff(bounds) + 1, pa.int64()), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in others), "n_tokens", "ids"])

    return df.mapInArrow(encode, schema)


def round_robin(sources: list, sizes: np.ndarray, shares: dict, carried: dict, offset: int, window: int = SEQUENCE, chunk: int = CHUNK) -> list[tuple[int, int, int]]:
    """The order in which a block's documents are served: (document, start, length), windows cut at multiples of `window`.

    In every window each waiting source's deficit grows by its share of the window. Sources take turns; one
    with a positive deficit serves chunks of its first document until the deficit is used up. When all waiting
    sources are in debt while the window has room, the least indebted one serves.
    """
    queues: dict = {}
    for i, s in enumerate(sources):
        queues.setdefault(s, deque()).append([i, 0, int(sizes[i])])
    deficit = {s: carried.get(s, 0.0) for s in queues}
    turn, out, at = deque(sorted(queues, key=str)), [], offset
    room = window - at % window

    def serve(s) -> None:
        nonlocal at, room
        head = queues[s][0]
        n = min(chunk, head[2] - head[1], room)
        out.append((head[0], head[1], n))
        head[1] += n
        at, room = at + n, room - n
        deficit[s] -= n
        if head[1] == head[2]:
            queues[s].popleft()
            if not queues[s]:
                turn.remove(s)

    while turn:
        for s in turn:
            deficit[s] += shares[s] * window
        while room and turn:
            idle = 0
            while room and turn and idle < len(turn):
                s = turn[0]
                if deficit[s] > 0:
                    serve(s)
                    idle = 0
                else:
                    idle += 1
                    turn.rotate(-1)
            if room and turn:
                serve(max(turn, key=deficit.get))
        if not room:
            room = window
    return out


def plan(sums: DataFrame, shares: dict | None) -> DataFrame:
    """(__b, __s, __start, __share, __carried) of sums (__block, __source, n): a block's first token, and for each of its
    sources the target share and what earlier blocks owe it.

    Running sums over blocks are made in stretches of STRETCH blocks, then over the stretches, so that no window
    holds more than STRETCH rows or the stretches' sums.
    """
    sums = sums.withColumn("__far", F.floor(F.col("__block") / STRETCH))

    def before(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
        """rows (one for each block and `by`) with the sum of `value` over all earlier blocks."""
        near = Window.partitionBy(*by, "__far").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        far = Window.partitionBy(*by).orderBy("__far").rowsBetween(Window.unboundedPreceding, -1)
        stretches = rows.groupBy(*by, "__far").agg(F.sum(value).alias("__sum"))
        stretches = stretches.withColumn("__base", F.coalesce(F.sum("__sum").over(far), F.lit(0))).drop("__sum")
        rows = rows.withColumn(name, F.coalesce(F.sum(value).over(near), F.lit(0)))
        return rows.join(stretches, [*by, "__far"]).withColumn(name, F.col(name) + F.col("__base")).drop("__base")

    blocks = before(sums.groupBy("__block", "__far").agg(F.sum("n").alias("n")).withColumn("__all", F.lit(0)), ["__all"], "n", "__start")
    served = before(sums, ["__source"], "n", "__served")
    total = sums.groupBy("__source").agg(F.sum("n").alias("__n"))
    share = F.col("__n") / F.sum("__n").over(Window.partitionBy())  # one row for each source
    if shares:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("__source")), F.lit(0.0))
    wanted = total.select("__source", share.cast("double").alias("__share"))
    rows = served.join(blocks.select("__block", "__start"), "__block").join(wanted, "__source")
    return rows.select(F.col("__block").alias("__b"), F.col("__source").alias("__s"), F.col("__start").cast("long").alias("__start"), "__share", (F.col("__share") * F.col("__start") - F.col("__served")).alias("__carried"))


def queued(frame: pd.DataFrame, blocks: int) -> pd.DataFrame:
    """A block's rows in the order of their queues: by hash, copies of a row evenly apart."""
    frame = frame.sort_values(["__place", "__key", "__source", "n_tokens"], kind="stable")
    same = frame.groupby("__place", sort=False)
    unit = (frame["__place"].to_numpy().view(np.uint64) // blocks) / float(2**64 // blocks + 1)
    at = (unit + same.cumcount().to_numpy() / same["__place"].transform("size").to_numpy()) % 1.0
    return frame.assign(__at=at).sort_values(["__at", "__place"], kind="stable")


def packed(df: DataFrame, tokenizer: str, key: str = "doc_id", source: str = "source", text: str = "text", shares: dict | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and source.

    shares: the target share of each source's tokens (by default its own share). Null keys and sources are
    values like others, a null text counts as empty; an empty table gives no rows; equal rows are packed each
    for itself, half the block apart if there are two of them, and so on. Other columns are left aside. The
    result depends on the rows alone, not on how Spark has dealt them (but for more than COPIES equal rows,
    which are dealt to blocks as they come). The driver holds one number, the tokens of all.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("string").alias("__key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__source"), text_column(text).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    with batch_bytes(spark):
        table = stored(tokens(rows, tokenizer, "__text").withColumn("__place", F.xxhash64("__key", "__source", F.crc32("ids"), "n_tokens")), "tokens")
    total = table.agg(F.sum("n_tokens")).first()[0] or 0
    blocks = max(1, -(-total // block_tokens))
    table = table.withColumn("__block", F.pmod("__place", F.lit(blocks)))
    many = stored(table.groupBy("__place").agg(F.count("*").alias("__n")).filter(F.col("__n") > COPIES), "copies")
    if not many.isEmpty():
        table = table.join(many, "__place", "left")
        spread = F.xxhash64("__place", F.pmod("__row", F.ceil(F.col("__n") / COPIES)))
        table = table.withColumn("__block", F.coalesce(F.pmod(spread, F.lit(blocks)), "__block")).drop("__n")
    table = table.drop("__row")
    dealt = plan(table.groupBy("__block", "__source").agg(F.sum("n_tokens").alias("n")), shares)
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"

    def pack(frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        offset = int(own["__start"].iloc[0])
        frame = queued(frame, blocks)
        sizes = frame["n_tokens"].to_numpy()
        width = len(frame["ids"].iloc[0]) // int(sizes[0])
        ids = [np.frombuffer(x, f"<u{width}") for x in frame["ids"]]
        order = round_robin(list(frame["__source"]), sizes, dict(zip(own["__s"], own["__share"])), dict(zip(own["__s"], own["__carried"])), offset)
        out, at = [], offset
        for i, begin, n in order:
            # neighbouring chunks of a document in one window are one piece
            if out and out[-1][0] == i and out[-1][1] + out[-1][2] == begin and at % SEQUENCE:
                out[-1][2] += n
            else:
                out.append([i, begin, n, at])
            at += n
        doc, begin, length, where = (np.array(x, np.int64) for x in zip(*out))
        crc = [zlib.crc32(ids[i][a : a + n].astype("<u4").tobytes()) for i, a, n in zip(doc, begin, length)]
        return pd.DataFrame({"doc_id": frame["__key"].iloc[doc].array, "start": begin, "length": length, "ids_crc32": crc, "doc_tokens": sizes[doc], "sequence_id": where // SEQUENCE, "offset": where % SEQUENCE, "source": frame["__source"].iloc[doc].array})

    out = table.groupBy("__block").cogroup(dealt.groupBy("__b")).applyInPandas(pack, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(df.schema[key].dataType))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of full sequences, each window mixed by the sources' shares."""
    return packed(documents(spark, sf_dir), tokenizer_path())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences; null and empty texts have the end id alone, an empty table has no pieces.

    Documents that the mixture reads again are rows of their own and stand apart from their copies.
    """
    return packed(docs, tokenizer_path())
