"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each document's set of word shingles is hashed by one function; its k smallest values are its sketch. Equal sets
   collapse to one representative first.
2. Inverted lists of retained values: two sets with a similarity of at least 0.8 share at least T of k values, so by the
   prefix principle they meet in a list even if each keeps only its rarest values. Lists hold no common boilerplate.
3. Union-sketch estimates within a list filter: leaders of a list are compared with all its members at once and give a
   forest of likely links, at most one for each member. No pairs within a list are written.
4. Exact Jaccard similarity over full sets verifies within each group of likely links. Rows outside the largest class
   are compared with all others, so that every link between classes is found without writing pairs.
Groups over a bound of rows or bytes are dealt as pairs of bounded blocks, so no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, cut, map_batches, map_groups
from tessera.llm.shingles import fingerprint, shingle_set

#: Values of a sketch, and the fewest that similar sets share: P(Binomial(32, 0.8) < 12) is below 1e-7.
SKETCH = 32
SHARED = 12
#: Chance to miss a link, at most, where links of less similarity need fewer shared values.
MISSED = 1e-7
#: Members of a list, and shingles of a group of likely links, in one block.
LIST_ROWS = 4096
GROUP_SHINGLES = 1_000_000


def least_shared(percent: int) -> int:
    """The fewest values that the sketches of sets of `percent` similarity share, but for a chance of MISSED."""
    below, k = 0.0, 0
    while k <= SHARED and (below := below + comb(SKETCH, k) * (percent / 100) ** k * (1 - percent / 100) ** (SKETCH - k)) < MISSED:
        k += 1
    if not k or percent > 100:
        raise ValueError(f"percent is {percent}: links below 40 percent may share no value of their sketches, above 100 there are none")
    return min(SHARED, k)


def signatures(df: DataFrame, words: int, lower: bool, id_col: str, text_col: str) -> DataFrame:
    """`id, n, print binary, sketch array<long>` of each row; texts without words have no print and an empty sketch."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        sets = [shingle_set(t, words, lower) for t in batch["text"]]
        return {"id": batch["id"], "n": [len(s) for s in sets], "print": [fingerprint(s) if len(s) else None for s in sets], "sketch": [s[:SKETCH] for s in sets]}

    source = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    return map_batches(source, run, "id long, n long, print binary, sketch array<long>")


def links(df: DataFrame, words: int = 5, percent: int = 80, lower: bool = False, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The signatures of `df` and edges `a, b` that join exactly the documents that links of `percent` similarity join.
    `percent` is 40 to 100."""
    shared = least_shared(percent)
    signed = cut(signatures(df, words, lower, id_col, text_col))
    named = signed.where("id is not null and print is not null")
    # Written aside, so that both sides of later joins are plain exchanges, whose hot partitions Spark can split.
    sets = cut(named.groupBy("print").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch")))
    copies = named.select("print", F.col("id").alias("a")).join(sets.select("print", F.col("id").alias("b")), "print").where("a <> b").select("a", "b").distinct()
    likely = components(_likely(sets.select("id", "sketch"), percent, shared))
    exact = _verified(df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")), likely, signed, words, percent, lower)
    return signed, cut(copies.unionByName(exact))


def classes(df: DataFrame, words: int = 5, percent: int = 80, lower: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col, n_shingles, component_id, kept` for each row of `df`.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets (`percent` from 40 to 100); `component_id` is the
    smallest id reachable over links, itself included. Null and empty texts, and texts of blanks, have an empty set and
    no link. Rows with a null id get a null component, no link, and are kept. Rows that repeat an id are one document
    that has all their sets; each keeps its row. Other columns are not read. An empty table gives an empty result.
    """
    signed, edges = links(df, words, percent, lower, id_col, text_col)
    found = components(edges)
    rows = signed.select("id", "n").join(found, signed.id == found.node, "left")
    component = F.coalesce("component", "id")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def representatives(df: DataFrame, words: int = 5, percent: int = 80, lower: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns, of the document with the smallest id of each class; null ids stay."""
    gone = classes(df, words, percent, lower, id_col, text_col).where("not kept").select(id_col).distinct()
    return df.join(gone, id_col, "left_anti").select(*df.columns)


def in_blocks(rows: DataFrame, key: str, id_col: str, blocks: Column) -> DataFrame:
    """Give each row of a group the pairs of blocks (`low`, `high`) that need it; one pair where `blocks` is 1."""
    own = F.pmod(F.xxhash64(id_col, F.lit(3)), F.col("blocks")).cast("int")
    dealt = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A block meets itself inside each pair with another, so the pair (i, i) is needed only where it is alone.
    dealt = dealt.where("blocks = 1 or own <> other")
    return dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("own", "other", "blocks")


def _likely(sets: DataFrame, percent: int, fewest: int) -> DataFrame:
    """Edges `a, b` of likely links between representatives `id, sketch`, which share `fewest` values."""
    values = sets.select("id", F.explode("sketch").alias("value"))
    counted = cut(values.groupBy("value").agg(F.count("*").alias("rows")).where("rows > 1"))
    shared = values.join(counted, "value").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rows", "value"))).alias("shared"))
    need = F.least(F.lit(fewest), F.ceil(F.size("sketch") * percent / 100)).cast("int")
    rare = sets.join(shared, "id").withColumn("spare", F.size("shared") - need + 1).where("spare > 0")
    listed = rare.select("id", "sketch", F.explode(F.slice("shared", F.lit(1), F.col("spare"))).alias("at")).select("id", "sketch", "at.value", "at.rows")
    dealt = in_blocks(listed, "value", "id", F.ceil(F.col("rows") / LIST_ROWS))

    def group(_: tuple, slices: list[pa.RecordBatch]) -> Iterable[dict[str, list]]:
        if sum(s.num_rows for s in slices) > 1:
            rows = pa.Table.from_batches(slices)
            order = np.argsort(rows["id"].to_numpy(), kind="stable")
            a, b = forest(rows["id"].to_numpy()[order], _padded(rows["sketch"], order), fewest)
            if len(a):
                yield {"a": a, "b": b}

    return map_groups(dealt.select("value", "low", "high", "id", "sketch"), ["value", "low", "high"], group, "a long, b long").distinct()


def _padded(column: pa.ChunkedArray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy()
    out = np.full((len(sizes), SKETCH), np.iinfo(np.int64).max)
    out[np.arange(SKETCH) < sizes[:, None]] = lists.flatten().to_numpy()
    return out[order], sizes[order]


def estimates(leader: np.ndarray, size: int, sketches: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Union-sketch estimates of the similarity to one sketch, in values of SKETCH.

    The SKETCH smallest values of the union of two sketches are the sketch of the union of the sets; the share of them
    that both retain estimates the similarity. Sets below SKETCH values are known whole.
    """
    own = leader[:size]
    place = np.searchsorted(own, sketches)
    inside = np.arange(sketches.shape[1]) < sizes[:, None]
    both = inside & (own[np.minimum(place, size - 1)] == sketches)
    before = np.cumsum(both, axis=1) - both
    rank = np.arange(sketches.shape[1]) + place - before
    union = np.minimum(SKETCH, size + sizes - both.sum(axis=1))
    return (both & (rank < SKETCH)).sum(axis=1) * SKETCH / union


def forest(ids: np.ndarray, padded: tuple[np.ndarray, np.ndarray], fewest: int = SHARED) -> tuple[list[int], list[int]]:
    """Links from members of a list to the least id of their class of likely links; ids ascend.

    Every sketch outside the largest class takes its turn as leader against all others: links inside that class change
    nothing, and links into it are found from the other end. So no likely link is lost.
    """
    sketches, sizes = padded
    label = np.arange(len(ids))
    turn = np.ones(len(ids), bool)
    while True:
        largest = np.bincount(label).argmax()
        waiting = np.flatnonzero(turn & (label != largest))
        if not len(waiting):
            break
        at = waiting[0]
        others = np.flatnonzero(label != label[at])
        alike = estimates(sketches[at], int(sizes[at]), sketches[others], sizes[others])
        joined = np.unique(np.append(label[others[alike >= fewest]], label[at]))
        label[np.isin(label, joined)] = joined.min()
        # The same sketch again would find the same.
        turn[(sketches == sketches[at]).all(axis=1)] = False
    hung = np.flatnonzero(label != np.arange(len(ids)))
    a, b = ids[hung], ids[label[hung]]
    return a[a != b].tolist(), b[a != b].tolist()


def _verified(texts: DataFrame, likely: DataFrame, signed: DataFrame, words: int, percent: int, lower: bool) -> DataFrame:
    """Edges `a, b` that join the classes of exact links within each group of likely links."""
    rows = likely.select(F.col("node").alias("id"), F.col("component").alias("grp")).join(texts, "id")
    rows = rows.where("text is not null")
    members = likely.join(signed.select(F.col("id").alias("node"), "n"), "node")
    weight = cut(members.groupBy(F.col("component").alias("grp")).agg(F.ceil(F.sum("n") / GROUP_SHINGLES).alias("blocks")))
    dealt = in_blocks(rows.join(weight, "grp"), "grp", "id", F.greatest("blocks", F.lit(1)))

    def group(_: tuple, slices: list[pa.RecordBatch]) -> Iterable[dict[str, list]]:
        if sum(s.num_rows for s in slices) > 1:
            ids = np.concatenate([s.column(s.schema.get_field_index("id")).to_numpy() for s in slices])
            sets = [shingle_set(t.as_py(), words, lower) for s in slices for t in s.column(s.schema.get_field_index("text"))]
            a, b = exact_classes(ids, sets, percent)
            if len(a):
                yield {"a": a, "b": b}

    return map_groups(dealt.select("grp", "low", "high", "id", "text"), ["grp", "low", "high"], group, "a long, b long").distinct()


def exact_classes(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Links from members to the least id of their class of exact links.

    A member outside the largest class takes its turn against all others through the inverted lists of shingles; links
    between members of the largest class can change nothing, and links into it are found from the other end.
    """
    order = np.argsort(ids, kind="stable")
    ids, sets = ids[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    if len(ids) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        hit = both and 100 * both >= percent * (sizes.sum() - both) and ids[0] != ids[1]
        return ([int(ids[1])], [int(ids[0])]) if hit else ([], [])
    value, at = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(len(ids)), sizes)
    by_value = member[np.argsort(at, kind="stable")]
    lengths = np.bincount(at, minlength=len(value))
    starts = np.cumsum(lengths) - lengths
    offsets = np.cumsum(sizes) - sizes
    label = np.arange(len(ids))
    turn = sizes > 0
    while True:
        largest = np.bincount(label).argmax()
        waiting = np.flatnonzero(turn & (label != largest))
        if not len(waiting):
            break
        i = waiting[0]
        turn[i] = False
        own = at[offsets[i] : offsets[i] + sizes[i]]
        length = lengths[own]
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        both = np.bincount(by_value[np.repeat(starts[own], length) + step], minlength=len(ids))
        joined = np.unique(label[100 * both >= percent * (sizes + sizes[i] - both)])
        label[np.isin(label, joined)] = joined.min()
    hung = np.flatnonzero(label != np.arange(len(ids)))
    a, b = ids[hung], ids[label[hung]]
    return a[a != b].tolist(), b[a != b].tolist()
