"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A text is the set of its distinct 5-word shingles. Equal sets are first joined
to one representative. A representative's signature is one b-bit MinHash value
for each of ``chunks * WIDTH`` positions, and two signatures differ in so many
positions. Split into ``chunks``, of two signatures that differ in no more than
``2 * chunks - 1`` positions one chunk differs in at most one (pigeonhole); so a
signature is filed under every chunk with every one position left out, and all
such pairs meet. A pair exactly at the link threshold differs in more positions
with the probability :func:`miss_probability`: 2.3e-6 at 85%, 3.3e-5 at 80%.

Files of two to ``BLOCK`` are compared in tasks, and no pair leaves a task: only
a spanning forest of the close pairs does. Larger files, whose pairs would be
too many, are joined to one group without a comparison. The components are
groups that hold every candidate pair whole; each is then told apart on the
full shingle sets. A group of up to ``SET_BLOCK`` is compared pair by pair in
one task. A larger one is first compared with some ``LEADERS`` of its members,
which joins most of a template's copies in one pass; after that, only its
members outside of its largest cluster are compared with all others, in pairs
of blocks. So a group of n near copies costs n comparisons, times the members
that no leader reaches. Again only forests of links leave the tasks; their
components are the result.

Defined results for odd input
    Null, empty or wordless text: 0 shingles, a component of its own. Very long
    texts are read whole. A null doc_id: no links, null component, kept.
    Repeated rows are in one component and all have doc_id = component_id if it
    is theirs; a doc_id that repeats with other text is linked by each of its
    texts. Ties go to the smallest doc_id. An empty table gives no rows.
    ``keep_one`` takes rows as they are: of each group of rows, whatever their
    doc_ids, exactly one stays. Other columns pass through it; its own start
    with ``_nd_``. Some of the tables behind a result (features and group
    names) stay in the shared folder, as the result is read from them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import mixed, shingle_set
from .tables import dropped, read, staged, text_key

WIDTH = 5
BLOCK, SET_BLOCK, LEADERS = 1024, 256, 16
_ODD = np.random.default_rng(11).integers(0, 1 << 63, 400, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(12).integers(0, 1 << 63, 400, dtype=np.int64).astype(np.uint64)


def miss_probability(percent: int, chunks: int) -> float:
    """How likely a pair with this similarity differs in more than ``2 * chunks - 1`` positions."""
    n, p = chunks * WIDTH, percent / 100
    return sum(math.comb(n, k) * (1 - p) ** k * p ** (n - k) for k in range(2 * chunks, n + 1))


def chunks_for(percent: int) -> int:
    """Enough chunks, 12 at least, that a pair at the threshold is out of reach with a probability below 4e-5."""
    if percent < 80:
        raise ValueError("pairs below 80 percent are out of the signatures' reach")
    return next(c for c in range(12, 80) if miss_probability(percent, c) < 4e-5)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of 16 bits."""
    least = np.full(n, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[at : at + 4096, None] * _ODD[:n] + _ADD[:n]).min(0), out=least)
    return (mixed(least) >> np.uint64(48)).astype("<u2")


def _set_hash(shingles: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def features(docs: DataFrame, chunks: int) -> DataFrame:
    """doc_id, n (shingles), a and b (hash of the set) and signature of each row."""

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            sets = [shingle_set(t) for t in p["text"]]
            hashes = [_set_hash(s) for s in sets]
            yield pd.DataFrame({"doc_id": p["doc_id"], "n": [len(s) for s in sets], "a": [h[0] for h in hashes], "b": [h[1] for h in hashes], "sig": [signature(s, chunks * WIDTH).tobytes() if len(s) else None for s in sets]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, "doc_id long, n long, a long, b long, sig binary")


def filed(reps: DataFrame, chunks: int) -> DataFrame:
    """rep, slot, key: a row for each chunk and each of its positions left out."""

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            sig = _matrix(p["sig"]).reshape(len(p), chunks, WIDTH).astype(np.uint64)
            keys = np.empty((len(p), chunks * WIDTH), np.uint64)
            for c in range(chunks):
                for v in range(WIDTH):
                    key = np.zeros(len(p), np.uint64)
                    for j in range(WIDTH):
                        if j != v:
                            key = (key << np.uint64(16)) | sig[:, c, j]
                    keys[:, c * WIDTH + v] = mixed(mixed(key) + np.uint64(c * WIDTH + v + 1))
            yield pd.DataFrame({"rep": p["rep"], "keys": list(keys.view(np.int64))})

    return reps.select("rep", "sig").mapInPandas(rows, "rep long, keys array<long>").select("rep", F.posexplode("keys").alias("slot", "key"))


def block_of(n: Column, size: int) -> tuple[Column, Column]:
    """The block of a row of a group of n, and how many blocks the group has."""
    parts = F.greatest(F.lit(1), F.ceil(n / F.lit(float(size)))).cast("int")
    return F.pmod(F.xxhash64("rep"), parts).cast("int"), parts


def _matrix(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), "<u2").reshape(len(sigs), -1) if len(sigs) else np.zeros((0, 0), "<u2")


class Forest:
    """Union-find over ids; gives each id with the least of its tree."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (y := up.setdefault(r, r)) != r:
            r = y
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> pd.DataFrame:
        out = [(x, r) for x in list(self.up) if (r := self.root(x)) != x]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def groups(it: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches that end where a group does, with the first row of each group.

    The rows come sorted; a group is bounded by its blocks, so is what is held.
    """
    held: list[pd.DataFrame] = []
    for p in it:
        if not len(p):
            continue
        whole = pd.concat([*held, p], ignore_index=True) if held else p
        k = whole[by].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(1)]))
        held = [whole.iloc[first[-1] :]]
        if len(first) > 1:
            yield whole.iloc[: first[-1]].reset_index(drop=True), first[:-1]
    if held:
        yield held[0].reset_index(drop=True), np.zeros(1, np.int64)


def pairs_within(first: np.ndarray, n: int, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside each group, ``most`` or so at a time."""
    sizes = np.diff(np.append(first, n))
    for s in np.unique(sizes[sizes > 1]):
        at = first[sizes == s]
        if s * (s - 1) // 2 <= most:
            i, j = np.triu_indices(s, 1)
            step = max(1, most // len(i))
            for k in range(0, len(at), step):
                yield (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
        else:
            for f in at:
                rows = max(1, most // s)
                for k in range(0, s, rows):
                    i, j = np.nonzero(np.arange(k, min(s, k + rows))[:, None] < np.arange(s)[None, :])
                    yield f + k + i, f + j


def close_edges(it: Iterator[pd.DataFrame], chunks: int) -> Iterator[pd.DataFrame]:
    """A forest of the pairs within reach of each other."""
    forest = Forest()
    for p, first in groups(it, ["key"]):
        sig, rep, slot = _matrix(p["sig"]), p["rep"].to_numpy(), p["slot"].to_numpy()
        for i, j in pairs_within(first, len(p)):
            same = sig[i] == sig[j]
            near = np.flatnonzero(same.sum(1) >= chunks * WIDTH - (2 * chunks - 1))
            if not len(near):
                continue
            # A pair counts in the first file that the two share.
            i, j, same = i[near], j[near], same[near].reshape(len(near), chunks, WIDTH)
            c = (same.sum(2) >= WIDTH - 1).argmax(1)
            at = same[np.arange(len(c)), c]
            v = np.where(at.all(1), 0, (~at).argmax(1))
            here = slot[i] == c * WIDTH + v
            for a, b in zip(rep[i[here]].tolist(), rep[j[here]].tolist()):
                forest.join(a, b)
    yield forest.edges()


def confirmed_edges(it: Iterator[pd.DataFrame], chunks: int, percent: int) -> Iterator[pd.DataFrame]:
    """A forest of the links that hold on the full shingle sets, between the sides of a group or, without sides, in it.

    Rows of one cluster are known to be linked and not compared.
    """
    forest = Forest()
    for p, first in groups(it, ["comp", "lo", "hi"]):
        sig, rep, cluster = _matrix(p["sig"]), p["rep"].to_numpy(), p["cluster"].to_numpy()
        side, cross = p["side"].to_numpy(), (p["lo"] != p["hi"]).to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in p["shingles"]]
        sizes = np.array([len(s) for s in sets])
        for i, j in pairs_within(first, len(p)):
            small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
            fit = (100 * small >= percent * large) & (~cross[i] | (side[i] != side[j])) & (cluster[i] != cluster[j])
            i, j = i[fit], j[fit]
            far = (sig[i] != sig[j]).sum(1)
            order = np.flatnonzero(far <= 2 * chunks - 1)
            order = order[np.argsort(far[order], kind="stable")]
            for a, b in zip(i[order].tolist(), j[order].tolist()):
                if forest.root(rep[a].item()) == forest.root(rep[b].item()):
                    continue
                both = np.concatenate([sets[a], sets[b]])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    forest.join(rep[a].item(), rep[b].item())
    yield forest.edges()


def candidate_groups(reps: DataFrame, chunks: int) -> DataFrame:
    """node, component: groups that hold every pair within reach whole."""
    rows = staged(filed(reps, chunks), "filed")
    often = staged(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1").withColumnRenamed("key", "often"), "often")
    met = rows.join(often, F.col("key") == F.col("often"))
    sigs = reps.select(F.col("rep").alias("r"), "sig")
    some = met.where(F.col("n") <= BLOCK).join(sigs, F.col("rep") == F.col("r")).select("key", "slot", "rep", "sig").repartition("key").sortWithinPartitions("key")
    edges = some.mapInPandas(lambda it: close_edges(it, chunks), "a long, b long")
    many = met.where((F.col("n") > BLOCK) & (F.col("rep") > F.col("least"))).select(F.col("rep").alias("a"), F.col("least").alias("b"))
    out = components(edges.unionByName(many))
    dropped(rows)
    dropped(often)
    return out


def linked_in_groups(known: DataFrame, chunks: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) that connect what is linked inside each group; ``known``: comp, n (null for small groups), rep, sig, shingles."""
    cols = ["comp", "lo", "hi", "side", "rep", "sig", "shingles", "cluster"]

    def compared(rows: DataFrame) -> DataFrame:
        dealt = rows.select(*cols).repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi")
        return dealt.mapInPandas(lambda it: confirmed_edges(it, chunks, percent), "a long, b long")

    own = known.withColumn("cluster", F.col("rep"))
    small = compared(own.where("n IS NULL").withColumns({"lo": F.lit(0), "hi": F.lit(0), "side": F.lit(True)}))
    large = own.where("n IS NOT NULL")
    if large.isEmpty():
        return small, []
    # Every member with each of the leaders, of which each block gets a copy.
    block, parts = block_of(F.col("n"), SET_BLOCK)
    members = large.withColumns({"lo": block, "hi": F.lit(-1), "side": F.lit(False)})
    leaders = large.where(F.pmod(F.xxhash64(F.lit(3), "rep"), "n") < LEADERS).withColumn("lo", F.explode(F.sequence(F.lit(0), parts - 1))).withColumns({"hi": F.lit(-1), "side": F.lit(True)})
    led = staged(compared(members.unionByName(leaders)), "led")
    names = components(led)
    # What is in a group's largest cluster is linked; all others meet each other and that cluster.
    placed = large.select("comp", "rep").join(names, F.col("rep") == F.col("node"), "left").select("comp", "rep", F.coalesce("component", "rep").alias("cluster"))
    placed = staged(placed, "clusters")
    main = placed.groupBy("comp", "cluster").agg(F.count("*").alias("size")).groupBy(F.col("comp").alias("c")).agg(F.max_by("cluster", F.struct("size", "cluster")).alias("main"), F.sum("size").alias("all"), F.max("size").alias("most"))
    main = staged(main.select("c", "main", (F.col("all") - F.col("most")).alias("few"), "most").where("few > 0"), "main")
    rest = large.drop("cluster").join(placed.select(F.col("rep").alias("r"), "cluster"), F.col("rep") == F.col("r")).join(main, F.col("comp") == F.col("c"))
    of_few, few = block_of(F.col("few"), SET_BLOCK)
    of_most, most = block_of(F.col("most"), SET_BLOCK)
    out = rest.withColumns({"_main": F.col("cluster") == F.col("main"), "_b": of_few, "_all": few, "_m": of_most, "_most": most})
    # Blocks below 0 are those of the largest cluster: its members go to each block of the others, not to each other.
    others = out.where("NOT _main").withColumn("_o", F.explode(F.sequence(-F.col("_most"), F.col("_all") - 1)))
    others = others.withColumns({"lo": F.least("_b", "_o"), "hi": F.greatest("_b", "_o"), "side": F.col("_b") <= F.col("_o")})
    most_of = out.where("_main").withColumn("hi", F.explode(F.sequence(F.lit(0), F.col("_all") - 1))).withColumns({"lo": -1 - F.col("_m"), "side": F.lit(True)})
    links = staged(compared(others.select(*cols).unionByName(most_of.select(*cols))), "rest")
    dropped(names)
    return small.unionByName(led).unionByName(links), [led, links, placed, main]


def near_groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    chunks = chunks_for(percent)
    feats = staged(features(docs, chunks), "shingled")
    reps = staged(feats.where("n > 0 AND doc_id IS NOT NULL").groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")), "representatives")
    close = candidate_groups(reps, chunks)

    # Only groups of more than a block need their size: a small table.
    large = staged(close.groupBy(F.col("component").alias("comp")).agg(F.count("*").alias("n")).where(F.col("n") > SET_BLOCK), "large")
    sized = close.join(large, F.col("component") == F.col("comp"), "left").select(F.col("component").alias("comp"), "n", F.col("node").alias("rep"))
    member = sized.join(reps.select(F.col("rep").alias("r"), "sig", "a", "b"), F.col("rep") == F.col("r")).drop("r")

    def sets(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            p["shingles"] = [shingle_set(t) for t in p["text"]]
            own = [_set_hash(s) == (a, b) for s, a, b in zip(p["shingles"], p["a"], p["b"])]  # a doc_id may repeat with other text
            p = p[own]
            yield p.assign(shingles=[s.tobytes() for s in p["shingles"]]).drop(columns=["text", "a", "b"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(member, F.col("doc_id") == F.col("rep")).select("comp", "n", "rep", "sig", "a", "b", "text")
    known = staged(texts.mapInPandas(sets, "comp long, n long, rep long, sig binary, shingles binary"), "sets")
    edges, used = linked_in_groups(known, chunks, percent)
    links = components(edges)

    named = reps.select("a", "b", "rep").join(links, F.col("rep") == F.col("node"), "left").select(F.col("a").alias("ra"), F.col("b").alias("rb"), F.coalesce("component", "rep").alias("component"))
    named = staged(named, "named")
    for done in (close, large, known, links, reps, *used):
        dropped(done)
    out = feats.join(named, (F.col("n") > 0) & (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb")), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group, all columns kept.

    A row is known by 64 bits of its doc_id and text, and so is a group: rows
    with one doc_id and different texts are judged each, and of equal rows one
    stays. Equal rows meet per task before they are shuffled.
    """
    own = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(text_key(F.col("text")), F.lit(b"")))
    gone = near_groups(docs.select(own.alias("doc_id"), "text"), percent).where(~F.col("kept")).select(F.col("doc_id").alias("_nd_gone")).distinct()
    rows = docs.withColumn("_nd_row", own).dropDuplicates(["_nd_row"])
    return rows.join(gone, F.col("_nd_row") == F.col("_nd_gone"), "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM s LEFT JOIN c ON s.doc_id = c.a
"""
