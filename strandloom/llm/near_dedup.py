"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct five-word shingles. Documents of one set are one class. A class keeps the K
smallest shingle hashes. Two sets with a Jaccard index of the threshold (PERCENT, in the pipeline STAGE_PERCENT)
or more share at least NEED of their K retained values (fewer than one pair in 10**9 has less; sets within K are
held whole, where it is certain), so they share one of each other's K - NEED + 1 rarest retained values. Only
these enter the inverted lists, which keeps frequent passages out of them. Short lists give pairs, whose union
sketch estimates their index, and full sets decide.

Classes in long lists get second lists, of their whole sets, where the overlap that the threshold asks for is
exact and a pair shares one of a sixth of its values, the rarest among these classes: documents of a common
template part here, as their own words are rarer. What is still in a long list (a text in very many versions)
forms clouds. A cloud's members are compared with its hub, and those near enough to be linked with the hub's
neighbours with some of these. Only members for which neither gives a link are compared with the cloud, in tiles
of bounded size whose distances from the hub allow a link.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.graph import connected_components
from . import kernels as K
from .url_filter import bloom, possible, small
from .util import batch_bytes, discarded, documents, freed, pieces, stored, text_column, untouched, within

SKETCH, PERCENT, STAGE_PERCENT = 64, 85, 80
#: By percentage: common values of SKETCH that two near sets have, and that their sketches' estimate is based on, each but for a chance under 1e-9.
NEED, ESTIMATE = {85: 34, 80: 30}, {85: 33 / SKETCH, 80: 29 / SKETCH}
#: Lists up to this length give their pairs.
SHORT = 32
#: Classes of one side of a tile, and shingles of them, about; neighbours of a hub that are asked as well.
TILE, TILE_VALUES, MORE_HUBS = 1024, 1 << 20, 16
#: Width of the steps of the index by which a cloud's tiles are told apart.
STEP = 0.05


def text_sets(column) -> tuple[np.ndarray, np.ndarray]:
    """The ascending distinct shingle hashes of each text, and bounds."""
    data, bounds = K.utf8(column)
    data = K.LOWER[data]
    starts, ends, first = K.words(data, bounds)
    values, at = K.shingles(K.span_hashes(data, starts, ends), first)
    return K.distinct_sorted(values, at)


def signatures(batches):
    freed()
    for batch in pieces(batches):
        values, bounds = text_sets(batch.column("text"))
        sizes = np.diff(bounds)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(values ^ K.MIX_2), dtype=np.uint64)])
        keys = K.mix((total[bounds[1:]] - total[bounds[:-1]]) * K.BASE + sizes.astype(np.uint64)).view(np.int64)
        raw = values.astype("<u8").tobytes()
        kept = np.minimum(sizes, SKETCH)
        sketches = [raw[8 * a : 8 * (a + n)] for a, n in zip(bounds[:-1], kept)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64(), mask=sizes == 0), pa.array(sketches, pa.binary())], names=["doc_id", "place", "n", "cls", "sketch"])


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit values of a binary column, and bounds."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view("<u8"), (offsets - offsets[0]) // 8


def entries(batches):
    """A row for each value of a class's sketch or set."""
    for batch in batches:
        if batch.num_rows:
            values, bounds = flat(batch.column("held"))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            for i in range(0, len(values), 1 << 18):
                part = owner[i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(values[i : i + (1 << 18)].view(np.int64)), batch.column("cls").take(pa.array(part)), batch.column("n").take(pa.array(part))], names=["v", "cls", "n"])


def similar(least: float | None):
    """A stage over pairs (a, b, na, nb, left, right): by sketches with an estimate from `least`, else by full sets."""

    def stage(batches):
        for batch in batches:
            x, xb = flat(batch.column("left"))
            y, yb = flat(batch.column("right"))
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            index = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                p, q = x[xb[i] : xb[i + 1]], y[yb[i] : yb[i + 1]]
                both = np.intersect1d(p, q, assume_unique=True)
                if least is None or (na[i] <= SKETCH and nb[i] <= SKETCH):
                    index[i] = len(both) / max(len(p) + len(q) - len(both), 1)
                else:
                    union = np.union1d(p, q)
                    k = min(SKETCH, len(union))
                    index[i] = np.searchsorted(both, union[k - 1], side="right") / k
            out = batch.select(["a", "b", "na", "nb"]).append_column("index", pa.array(index))
            yield out if least is None else out.filter(pa.array(index >= least))

    return stage


MEASURES = "a long, b long, na long, nb long, index double"


def rarest(classes: DataFrame, held: str, kept, need) -> DataFrame:
    """(v, cls, n): of each class's values those that it must share one of, with a partner that has `need` of its `kept`.

    Values of one class alone come first in the order of rarity and need no list.
    """
    values = classes.select("cls", "n", F.col(held).alias("held")).mapInArrow(entries, "v long, cls long, n long")
    common = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("cls")
    hits = values.join(common, "v").withColumn("rank", F.row_number().over(own.orderBy("df", "v"))).withColumn("found", F.count("*").over(own))
    return hits.filter(F.col("rank") <= kept - need + 1 - (kept - F.col("found"))).select("v", "cls", "n")


def listed(hits: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b, na, nb) of fitting sizes in short lists, and (cls, n, least) for each class of a long list."""
    sizes = hits.groupBy("v").agg(F.count("*").alias("size"), F.min("cls").alias("least")).filter("size > 1")
    short, long = sizes.filter(F.col("size") <= SHORT).select("v"), sizes.filter(F.col("size") > SHORT).select("v", "least")
    rows = hits.join(short, "v")
    left = rows.select("v", F.col("cls").alias("a"), F.col("n").alias("na"))
    right = rows.select(F.col("v").alias("w"), F.col("cls").alias("b"), F.col("n").alias("nb"))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    pairs = left.join(right, (F.col("v") == F.col("w")) & (F.col("a") < F.col("b")) & fits).select("a", "b", "na", "nb").distinct()
    return pairs, hits.join(long, "v").select("cls", "n", "least")


def with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    side = lambda c, name: table.select(F.col("cls").alias(c), F.col(column).alias(name))
    return pairs.join(side("a", "left"), "a").join(side("b", "right"), "b")


def sets_of(wanted: DataFrame, texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """(cls, n, shingles), one row for each class wanted (cls, n, doc_id, place).

    Sets are wider than texts, so they aren't dealt by class to drop doubles: only where a (doc_id, place) is in
    `repeated` has a class several rows, and these are dropped as texts. A Bloom filter of the places wanted, where
    it is small enough to be broadcast, keeps most other texts from being dealt for the join, which decides.
    """
    filtered, blocks = bloom(wanted, key=("place",))
    if small(blocks):
        texts = possible(texts, filtered, blocks, ("place",))
    where = wanted.withColumnsRenamed({"doc_id": "id", "place": "at"})
    marked = repeated.withColumnsRenamed({"doc_id": "id", "place": "at"})
    same = where["id"].eqNullSafe(marked["id"]) & (where["at"] == marked["at"])

    def found(rows: DataFrame) -> DataFrame:
        return texts.join(rows, (texts["place"] == rows["at"]) & texts["doc_id"].eqNullSafe(rows["id"])).select("cls", "n", "text")

    rows = found(where.join(marked, same, "left_anti")).unionByName(found(where.join(marked, same, "left_semi")).dropDuplicates(["cls"]))
    with batch_bytes(texts.sparkSession):
        return stored(rows.mapInArrow(full_sets, "cls long, n long, shingles binary"), "sets")


@within("links")
def near_links(classes: DataFrame, texts: DataFrame, repeated: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (src, dst) between classes that suffice for the components of all pairs from `percent` on.

    repeated: every (doc_id, place) that several rows of texts have.
    """
    kept = F.least("n", F.lit(SKETCH))
    # where n / percent is within SKETCH, a partner's set is within the sketch as well, and the needed overlap is exact
    needed = F.ceil(F.col("n") * percent / 100)
    need = F.when(F.col("n") <= SKETCH * percent // 100, needed).otherwise(F.least(F.lit(NEED[percent]), kept))
    lists = stored(rarest(classes, "sketch", kept, need), "lists")
    pairs, crowd = listed(lists, percent)
    estimated = lambda rows, sketches: with_both(rows, sketches, "sketch").mapInArrow(similar(ESTIMATE[percent]), MEASURES).drop("index")
    pairs = stored(estimated(pairs, classes), "pairs")
    crowd = stored(crowd.select("cls").distinct(), "crowd")
    discarded(lists)

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(crowd).distinct()
    wanted = stored(wanted.join(classes.select("cls", "n", "doc_id", "place"), "cls"), "wanted")
    sets = sets_of(wanted, texts, repeated)
    discarded(wanted)
    # what follows about long lists and clouds reads and deals the sets of these classes alone
    crowded = stored(sets.join(crowd, "cls", "left_semi"), "crowded")
    exact = lambda rows, table: with_both(rows, table, "shingles").mapInArrow(similar(None), MEASURES)
    near = F.col("index") * 100 >= percent - 1e-9
    linked = lambda rows: rows.filter(near).select(F.col("a").alias("src"), F.col("b").alias("dst"))

    lists = stored(rarest(crowded, "shingles", F.col("n"), needed), "lists")
    more, clouded = listed(lists, percent)
    sketches = crowded.select("cls", F.substring("shingles", 1, 8 * SKETCH).alias("sketch"))
    more = stored(estimated(more.join(pairs, ["a", "b"], "left_anti").select("a", "b", "na", "nb"), sketches), "pairs")
    clouded = stored(clouded, "clouded")
    discarded(lists)
    links = stored(linked(exact(pairs.unionByName(more), sets)), "linked")
    discarded(sets, pairs, more)

    clouds = connected_components(clouded.select(F.col("cls").alias("src"), F.col("least").alias("dst")))
    counts = clouded.groupBy("cls").agg(F.count("*").alias("lists"), F.first("n").alias("n"))
    members = counts.join(clouds, F.col("cls") == F.col("node")).select("cls", "n", "lists", F.col("component").alias("cloud"))
    members = stored(members, "members")
    held = stored(crowded.join(members, "cls", "left_semi"), "held")
    discarded(crowded)
    hubs = members.groupBy("cloud").agg(F.min_by(F.struct("cls", "n"), F.struct(-F.col("lists"), F.col("cls"))).alias("hub"))
    to_hub = members.join(hubs, "cloud").select(F.col("hub.cls").alias("a"), F.col("cls").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"))
    to_hub = stored(exact(to_hub, held), "hubs")
    members = members.join(to_hub.select(F.col("b").alias("cls"), "index"), "cls").select("cloud", "cls", "n", "index")

    # members that can be linked with the hub's neighbours, with some of these
    neighbours = members.filter(near).groupBy("cloud", F.pmod(F.xxhash64("cls"), F.lit(MORE_HUBS))).agg(F.min_by(F.struct("cls", "n"), F.xxhash64("cls", F.lit(1))).alias("hub"))
    between = members.filter(~near & (F.col("index") >= 2 * percent / 100 - 1 - 1e-9))
    asked = between.join(neighbours.select("cloud", "hub"), "cloud").select(F.col("hub.cls").alias("a"), F.col("cls").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"))
    second = stored(linked(exact(asked, held)), "second")
    rest = members.filter(~near).join(second.select(F.col("dst").alias("cls")).distinct(), "cls", "left_anti")
    return links.unionByName(linked(to_hub)).unionByName(second).unionByName(tiled(members, stored(rest, "rest"), held, percent))


def tiled(members: DataFrame, rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the rest (cloud, cls, n, index with the hub) with the cloud's members.

    Blocks are of one step of the index, so that both sides of a tile hold about TILE classes and TILE_VALUES
    shingles; indexes of two linked classes differ by 1 - percent / 100 at most, as their distances do.
    """
    far = int((1 - percent / 100) / STEP) + 1

    def blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = rows.withColumn("step", F.floor(F.col("index") / STEP).cast("int"))
        sizes = rows.groupBy("cloud", "step").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_VALUES)).cast("int").alias("parts"))
        return rows.join(sizes, ["cloud", "step"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).drop("parts"), sizes

    held, held_sizes = blocks(members)
    asks, ask_sizes = blocks(rest)
    tiles = ask_sizes.withColumnsRenamed({"step": "ask_step", "parts": "ask_parts"}).join(held_sizes, "cloud").filter(F.abs(F.col("step") - F.col("ask_step")) <= far)
    tiles = tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("ask_part", F.explode(F.sequence(F.lit(0), F.col("ask_parts") - 1)))
    tiles = tiles.select("cloud", "step", "part", "ask_step", "ask_part")
    columns = ["cloud", "step", "part", "ask_step", "ask_part", "cls", "n", "index", "shingles", "asks"]
    held = tiles.join(held.join(sets.select("cls", "shingles"), "cls"), ["cloud", "step", "part"]).withColumn("asks", F.lit(False))
    asks = tiles.join(asks.join(sets.select("cls", "shingles"), "cls").withColumnsRenamed({"step": "ask_step", "part": "ask_part"}), ["cloud", "ask_step", "ask_part"]).withColumn("asks", F.lit(True))
    rows = held.select(columns).unionByName(asks.select(columns))
    return rows.groupBy("cloud", "step", "part", "ask_step", "ask_part").applyInPandas(lambda frame: block_links(frame, percent), "src long, dst long")


def block_links(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the asking and the held classes of a tile that join different groups."""
    held, asking = frame[~frame.asks], frame[frame.asks]
    if not len(held) or not len(asking):
        return pd.DataFrame({"src": pd.Series(dtype="int64"), "dst": pd.Series(dtype="int64")})
    ids, sizes, near = held.cls.to_numpy(), held.n.to_numpy(), held["index"].to_numpy()
    values = [np.frombuffer(x, "<u8") for x in held.shingles]
    owner = np.repeat(np.arange(len(values)), [len(x) for x in values])
    values = np.concatenate(values)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    group = {int(c): (-1 if j * 100 >= percent - 1e-9 else int(c)) for c, j in zip(ids, near)}  # -1: the hub's

    def root(c: int) -> int:
        while group.get(c, c) != c and c != -1:
            c = group[c]
        return c

    out = []
    for cls, n, j, raw in zip(asking.cls, asking.n, asking["index"], asking.shingles):
        mine = np.frombuffer(raw, "<u8")
        low, high = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
        both = np.bincount(owner[K.ragged(low, high - low)], minlength=len(ids))
        # distances to the hub that differ by more than the limit rule a link out
        linked = (100 * both >= percent * (n + sizes - both)) & (ids != cls) & (np.abs(near - j) <= 1 - percent / 100 + 1e-9)
        for other in ids[linked]:
            a, b = root(int(cls)), root(int(other))
            if a != b:
                group[a if a != -1 else b] = b if a != -1 else a
                out.append((int(cls), int(other)))
    return pd.DataFrame(out, columns=["src", "dst"]).astype("int64")


def full_sets(batches):
    freed()
    for batch in pieces(batches):
        values, bounds = text_sets(batch.column("text"))
        raw = values.astype("<u8").tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], names=["cls", "n", "shingles"])


def components(df: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, place, n_shingles, component_id, kept) for every row of df (doc_id long, text), linked from a Jaccard index of `percent` on (85 or 80).

    A text without words (or null) is a component of its own. A component's id is its smallest doc_id, null
    ids left aside; kept says that a row's id is that id (both null counts). Rows with one doc_id and one text
    have one verdict. place is a hash of the text.
    """
    rows = labelled(df, percent)
    least = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    rows = rows.join(least, "label", "left")
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return rows.select("doc_id", "place", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


@within("labelled")
def labelled(df: DataFrame, percent: int) -> DataFrame:
    """(doc_id, place, n, label) of every row: the class, or the group of classes, that its text belongs to; null without words."""
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"), F.xxhash64(text_column()).alias("place"))
    with batch_bytes(df.sparkSession):
        marks = stored(texts.mapInArrow(signatures, "doc_id long, place long, n long, cls long, sketch binary"), "signatures")
    classes = stored(marks.filter("n > 0").dropDuplicates(["cls"]), "classes")
    repeated = stored(marks.filter("n > 0").groupBy("doc_id", "place").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id", "place"), "repeated")
    labels = connected_components(near_links(classes, texts, repeated, percent))
    rows = marks.select("doc_id", "place", "n", "cls").join(labels, F.col("cls") == F.col("node"), "left").withColumn("label", F.coalesce("component", "cls"))
    return rows.select("doc_id", "place", "n", "label")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id.

    Documents without words (null or empty texts) are components of their own and stay; an empty table stays
    empty. Rows with one doc_id and one text stay or go together.
    """
    verdict = components(docs, STAGE_PERCENT).filter("kept").select(F.col("doc_id").alias("__id"), F.col("place").alias("__place")).distinct()
    place = F.xxhash64(text_column())
    return untouched(docs, ("doc_id", "text"), lambda df: df.join(verdict, F.col("doc_id").eqNullSafe(F.col("__id")) & (place == F.col("__place")), "left_semi"))
