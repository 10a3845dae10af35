"""Near-duplicate groups of documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1.  Every text is read once and sketched: size and hash of its shingle set, a signature of one byte per hash function,
    and its label's head in each tree.  Documents with equal sets become one row with the least document's id.
2.  A tree is an order of the signatures; a region is the set of rows that share the first ``depth`` values of that
    order.  Rows alone in their region leave.  Regions beyond ``region_rows`` are cut again at a longer common prefix,
    until they are small: dense regions are looked at more deeply than sparse ones.
3.  Within a region in label order, candidates are pairs whose signatures agree well enough: all such pairs in a small
    region; in a larger one each row with its neighbours by longest common prefix and with the region's middle rows.
4.  Candidates are confirmed on full shingle sets, and linked rows form components.
5.  Where a group of loosely alike rows is still in several components, no link may depend on neighbours alone.  Sets at
    the threshold share one of the rarest shingles of each (so many that the rest could not reach the threshold), so
    rows that share such a shingle are candidates too; the few rows whose rarest shingles are frequent in their group
    are compared with one another, in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_batches, small, staged
from .components import connected_components, least_reachable
from .shingles import mix, shingle_set

SHINGLE_WORDS = 5
#: Links need 100 * intersection >= 85 * union.
PERCENT = 85
HASHES = 128
TREES = 24
#: Values in the shortest common prefix that makes two rows candidates; longer prefixes are tried in dense regions.
DEPTHS = (4, 7, 10, 14)
#: A pair at the threshold shares a region in a tree with probability 0.85 ** 4; all 24 trees miss it once in 5e7.
SMALL_REGION = 24
REGION_ROWS = 2048
NEIGHBOURS = 4
HUBS = 3
#: Signatures must agree in so many hashes of 128 for a pair to be confirmed on full sets: 4.7 deviations below 0.85.
AGREE = 89
#: Rows of texts or sets in a batch handed to Python.
BATCH_ROWS = 1000
#: A shingle that more rows of a group have among their rarest is frequent.
RARE_ROWS = 24
#: Shingles, and rows, that a block of the last comparison holds, about.
BLOCK_SHINGLES, BLOCK_ROWS = 1_000_000, 256

#: What tells shingle sets apart.
SET = ("n_shingles", "set_a", "set_b")

_ORDERS = [np.random.default_rng(1000 + t).permutation(HASHES)[: DEPTHS[-1]] for t in range(TREES)]
_random = np.random.default_rng(99)
_MULTIPLIERS = (_random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_OFFSETS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """One byte per hash function: of the least hash of the set."""
    least = np.full(HASHES, np.iinfo(np.uint32).max, dtype=np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 1024):
        np.minimum(least, (_MULTIPLIERS * short[None, i : i + 1024] + _OFFSETS).min(axis=1), out=least)
    return (mix(least.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)


def _head(signatures: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """A hash of the first ``depth`` values in the tree's order, per row."""
    h = np.full(len(signatures), np.uint64(tree * 31 + depth))
    for column in _ORDERS[tree][:depth]:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + signatures[:, column].astype(np.uint64) + np.uint64(1))
    return h.astype(np.int64)


def set_hashes(shingles: np.ndarray) -> tuple[int, int, int]:
    """The values of ``SET``: size, sum and combined bits of a shingle set."""
    return len(shingles), int(shingles.sum().astype(np.int64)), int(np.bitwise_xor.reduce(mix(shingles), initial=0).astype(np.int64))


def sketches(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``set_a``, ``set_b`` (hashes of the whole set), ``signature``."""

    def sketch(batches):
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingle_set(text if isinstance(text, str) else None, k)
                rows.append((*set_hashes(s), signature(s).tobytes() if len(s) else b""))
            out = pd.DataFrame(rows, columns=[*SET, "signature"])
            yield out.assign(doc_id=batch["doc_id"].to_numpy())[["doc_id", *SET, "signature"]]

    # The key travels as text: a batch that holds a null would round large numbers.
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = named.mapInPandas(sketch, "doc_id string, n_shingles long, set_a long, set_b long, signature binary")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _signatures(batch: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(batch["signature"]), dtype=np.uint8).reshape(len(batch), HASHES)


def _regions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (``rep``, ``signature``) that share a region with others, as (``rep``, ``tree``, ``region``) of small regions
    and the same with ``signature`` of larger ones."""

    def heads(batches):
        for batch in batches:
            signatures = _signatures(batch)
            for tree in range(TREES):
                yield pd.DataFrame({"rep": batch["rep"], "tree": tree, "region": _head(signatures, tree, DEPTHS[0])})

    def deeper(depth):
        def step(batches):
            for batch in batches:
                signatures, region = _signatures(batch), batch["region"].to_numpy().copy()
                for tree in np.unique(batch["tree"]):
                    own = np.flatnonzero(batch["tree"].to_numpy() == tree)
                    region[own] = _head(signatures[own], tree, depth)
                yield batch[["rep", "tree"]].assign(region=region)

        return step

    def shared(table):
        counts = table.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return staged(table.join(small(staged(counts, "forest-counts")), ["tree", "region"]), "forest-regions")

    columns, few, many = ["rep", "tree", "region"], [], []
    found = shared(rows.mapInPandas(heads, "rep long, tree int, region long"))
    for depth in (*DEPTHS[1:], None):
        few.append(found.where(F.col("n") <= SMALL_REGION).select(columns))
        many.append(found.where((F.col("n") > SMALL_REGION) & (F.col("n") <= REGION_ROWS)).select(columns))
        dense = found.where(F.col("n") > REGION_ROWS)
        if dense.isEmpty():
            break
        if depth is None:
            # What no prefix separates is dealt by id; the last comparison joins what the deal parts.
            part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / REGION_ROWS))
            many.append(dense.select("rep", "tree", F.xxhash64("region", part).alias("region")))
            break
        found = shared(dense.select(columns).join(rows, "rep").mapInPandas(deeper(depth), "rep long, tree int, region long"))
    return _union(few), _union(many).join(rows, "rep")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _candidates(rows: DataFrame) -> DataFrame:
    """``a`` < ``b`` with ``pair``: rows whose signatures agree, from every region, and ``loose``: links with the same
    components.  In larger regions those are one for each row but the first, and need not be pairs."""
    few, many = _regions(rows)

    def agreeing(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c]), dtype=np.uint8).reshape(len(batch), HASHES) for c in ("x", "y"))
            yield batch.loc[(x == y).sum(axis=1) >= AGREE, ["a", "b"]]

    left, right = (few.select(F.col("rep").alias(c), "tree", "region") for c in ("a", "b"))
    pairs = left.join(right, ["tree", "region"]).where("a < b").select("a", "b").distinct()
    for name, signature_ in (("a", "x"), ("b", "y")):
        pairs = pairs.join(rows.select(F.col("rep").alias(name), F.col("signature").alias(signature_)), name)
    close = pairs.mapInPandas(agreeing, "a long, b long")

    def compare(region: pd.DataFrame) -> pd.DataFrame:
        signatures, ids = _signatures(region), region["rep"].to_numpy()
        order = np.lexsort([ids, *signatures[:, _ORDERS[int(region["tree"].iloc[0])]].T[::-1]])
        signatures, ids, n = signatures[order], ids[order], len(ids)
        common = np.array([np.bincount(c, minlength=256).argmax() for c in signatures.T], dtype=np.uint8)
        hubs = np.argsort(-(signatures == common).sum(axis=1), kind="stable")[:HUBS]
        near = [(np.arange(n - d), np.arange(d, n)) for d in range(1, min(NEIGHBOURS, n - 1) + 1)] + [(np.full(n, h), np.arange(n)) for h in hubs]
        i, j = (np.concatenate(x) for x in zip(*near, strict=True))
        good = np.concatenate([(signatures[i[s]] == signatures[j[s]]).sum(axis=1) >= AGREE for s in _slices(len(i), 16384)])
        good &= i != j
        i, j = i[good], j[good]
        root = least_reachable(n, i, j)
        a, b, pair = np.concatenate([ids[i], ids]), np.concatenate([ids[j], ids[root]]), np.arange(len(i) + n) < len(i)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "pair": pair, "loose": ~pair})[a != b]

    dense = many.groupBy("tree", "region").applyInPandas(compare, "a long, b long, pair boolean, loose boolean")
    return close.select("a", "b", F.lit(True).alias("pair"), F.lit(True).alias("loose")).union(dense)


def _slices(n: int, step: int):
    return [slice(i, min(i + step, n)) for i in range(0, n, step)]


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``id``, ``shingles`` (sorted 64-bit hashes as bytes) of the sets named, by ``id``, ``doc_id``, ``shared`` and their
    hashes; the texts under these keys alone are exchanged, if at all."""
    keys = wanted.groupBy("doc_id").agg(F.max("shared").alias("shared"), *[F.first(c).alias(f"{c}_") for c in SET])
    texts = docs.select("doc_id", "text").join(small(staged(keys, "forest-keys"), 5 * BROADCAST_ROWS), "doc_id")

    def shingle(batches):
        for batch in batches:
            rows = []
            for text, shared, *own in zip(*(batch[c] for c in ("text", "shared", *(f"{c}_" for c in SET), "doc_id")), strict=True):
                found = shingle_set(text if isinstance(text, str) else None, k)
                # A repeated key may carry other texts; the one whose set was sketched is told by its set.
                if len(found) and (shared or set_hashes(found) == tuple(own[:3])):
                    rows.append((own[3], shared, *set_hashes(found), found.tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "shared", *SET, "shingles"])

    sets = texts.mapInPandas(shingle, "doc_id long, shared boolean, n_shingles long, set_a long, set_b long, shingles binary")
    sets = sets.select(_node(F.col("shared"), F.col("doc_id")).alias("id"), "shingles")
    return staged(sets.dropDuplicates(["id"]), "forest-sets")


def _node(shared, key):
    """A set's number: the key of its text, or a hash of the set where several sets have the same least key."""
    return F.when(shared, F.xxhash64(*SET)).otherwise(key)


def _linked(shared, total: int | np.ndarray, percent: int):
    """Whether sets with so many shared elements, of so many in both together, are near duplicates."""
    return 100 * shared >= percent * (total - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def confirm(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                keep.append(_linked(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y), percent))
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    left, right = (sets.select(F.col("id").alias(i), F.col("shingles").alias(s)) for i, s in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(confirm, "a long, b long")


def _open_rows(loose: DataFrame, strict: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of groups of loosely alike rows that are in several components: ``part`` (the group), ``id``, ``component``,
    ``asks`` (whether the row is outside the group's largest component), ``n``, ``shingles``."""
    rows = (
        loose.select(F.col("node").alias("id"), F.col("component").alias("part"))
        .join(strict.select(F.col("node").alias("id"), "component"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    rows = staged(rows, "forest-groups")
    tally = rows.groupBy("part", "component").agg(F.count(F.lit(1)).alias("rows"))
    groups = tally.groupBy("part").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("rows", "component"))["component"].alias("main"))
    groups = staged(groups.where("parts > 1").select("part", "main"), "forest-open")
    found = rows.join(small(groups), "part").join(sets, "id")
    return found.select("part", "id", "component", (F.col("component") != F.col("main")).alias("asks"), F.expr("octet_length(shingles) div 8").alias("n"), "shingles")


def _rarest(rows: DataFrame, percent: int) -> DataFrame:
    """(``part``, ``id``, ``shingle``) of each row's rarest shingles within its group, those that no other row has left out.

    Two sets at the threshold share ``percent`` of the larger one's shingles at least, so of the rarest n - n * percent
    + 1, in one order for all, they share one.  A frequent shingle's rows may be split where counts are joined to them.
    """

    def unpack(batches):
        for batch in batches:
            sizes = batch["n"].to_numpy()
            shingles = np.frombuffer(b"".join(batch["shingles"]), dtype=np.int64)
            yield pd.DataFrame({c: np.repeat(batch[c].to_numpy(), sizes) for c in ("part", "id", "n")} | {"shingle": shingles})

    single = staged(rows.select("part", "id", "n", "shingles").mapInPandas(unpack, "part long, id long, n long, shingle long"), "forest-shingles")
    counts = single.groupBy("part", "shingle").agg(F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(W.partitionBy("part", "id").orderBy("rows", "shingle"))
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    ranked = single.join(counts, ["part", "shingle"]).withColumn("place", place)
    return ranked.where((F.col("place") <= most) & (F.col("rows") > 1)).select("part", "id", "shingle")


def _last_links(loose: DataFrame, strict: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that the candidates left apart, from groups of loosely alike rows.

    ``loose``: (``node``, ``component``) over all candidates; ``strict``: the same over confirmed links.  Rows outside
    their group's largest component are compared with every row that shares one of the rarest shingles of both: through
    the shingle's list of rows where that is short; else both rows are in the group's core, which is compared in blocks
    of bounded size.
    """
    rows = staged(_open_rows(loose, strict, sets.select("id", "shingles")), "forest-rows")
    if rows.isEmpty():
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"))
    keys = rows.drop("shingles")
    postings = staged(_rarest(rows, percent).join(keys, ["part", "id"]), "forest-postings")
    lists = postings.groupBy("part", "shingle").agg(
        F.count(F.lit(1)).alias("rows"), F.max("asks").alias("asked"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    # Only lists in which a row that asks meets another component; each keeps its length.
    lists = lists.where("asked AND low < high").select("part", "shingle", "rows")
    useful = staged(postings.join(lists, ["part", "shingle"]), "forest-lists")
    short = useful.where(F.col("rows") <= RARE_ROWS)
    sides = [short.select("part", "shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "component", "asks", "n")]) for s in ("a", "b")]
    pairs = sides[0].join(sides[1], ["part", "shingle"]).where(
        (F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")) & (F.col("asks_a") | F.col("asks_b"))
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    )
    pairs = staged(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "forest-rare-pairs")
    core = useful.where(F.col("rows") > RARE_ROWS).select("part", "id").distinct()
    return _confirmed(pairs, sets, percent).union(_core_links(staged(rows.join(core, ["part", "id"]), "forest-core"), percent))


def _core_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links of rows that ask with rows of other components in their group, one for each row and component in a block."""
    blocks = lambda n, shingles: F.greatest(F.lit(1), F.ceil(n / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    asking = lambda c: F.sum(F.when(F.col("asks"), c).otherwise(0))
    groups = rows.groupBy("part").agg(blocks(F.count(F.lit(1)), F.sum("n")).alias("tall"), blocks(asking(F.lit(1)), asking(F.col("n"))).alias("wide"))
    full = rows.join(small(staged(groups, "forest-blocks")), "part").withColumns(
        {"row": F.pmod(F.xxhash64("id"), F.col("tall")).cast("int"), "column": F.pmod(F.xxhash64("id", F.lit(7)), F.col("wide")).cast("int")}
    )
    members = full.select("part", "row", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("column"), "id", "component", "shingles", F.lit(False).alias("asks"))
    queries = full.where("asks").select("part", F.explode(F.sequence(F.lit(0), F.col("tall") - 1)).alias("row"), "column", "id", "component", "shingles", F.lit(True).alias("asks"))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        asks = block["asks"].to_numpy()
        rows, queries, out = block[~asks].sort_values(["component", "id"]), block[asks], []
        if rows.empty or queries.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        sets = [np.frombuffer(s, dtype=np.uint64) for s in rows["shingles"]]
        lengths = np.array([len(s) for s in sets])
        flat, starts = np.concatenate(sets), np.cumsum(lengths) - lengths
        ids, components = rows["id"].to_numpy(), rows["component"].to_numpy()
        for q, own, shingles in zip(queries["id"], queries["component"], queries["shingles"], strict=True):
            s = np.frombuffer(shingles, dtype=np.uint64)
            shared = np.add.reduceat(s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat, starts, dtype=np.int64)
            hits = np.flatnonzero(_linked(shared, lengths + len(s), percent) & (components != own))
            one = np.unique(components[hits], return_index=True)[1]
            out += [(min(q, x), max(q, x)) for x in ids[hits[one]]]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return members.union(queries).groupBy("part", "row", "column").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (the least key reachable over links), ``kept`` (whether it is the row's own).

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a set holds the distinct runs of ``k``
    words, or the whole sequence where there are fewer.  Documents are linked if 100 * |A and B| >= percent * |A or B|.
    Null and empty texts have the empty set and are linked with nothing.  Repeated rows come out once each; rows that
    share a key share its component, which holds what any of its texts is linked with.  A null key takes no part in links and is its own component (null, kept).
    An empty table gives no rows; other columns are not read.  Keys are whole numbers (or cast to them).
    """
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return _near_duplicates(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), k, percent)


def _distinct_sets(usable: DataFrame) -> DataFrame:
    """``rep`` (a number for each set, see ``_node``), ``doc_id`` (the least key), ``shared``, hashes and ``signature`` of the sets."""
    sets = staged(usable.groupBy(*SET).agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")), "forest-distinct")
    shared = sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("shared"))
    found = sets.join(small(staged(shared, "forest-shared")), "doc_id", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    return found.withColumn("rep", _node(F.col("shared"), F.col("doc_id")))


def _one_key(member: DataFrame) -> DataFrame:
    """Links ``a`` - ``b`` between the sets of a key, the least with each other one."""
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id", "a")
    several = staged(several, "forest-several")
    return member.join(small(several), "doc_id").where("a < rep").select("a", F.col("rep").alias("b")).distinct()


def _least_keys(strict: DataFrame, distinct: DataFrame) -> DataFrame:
    """``strict`` with the least key in place of the least number of a set, for components with sets whose number is a hash."""
    hashed = staged(distinct.where("shared").select(F.col("rep").alias("node"), "doc_id"), "forest-hashed")
    if hashed.isEmpty():
        return strict
    named = strict.join(small(hashed), "node", "left")
    touched = named.groupBy("component").agg(F.min(F.coalesce("doc_id", "node")).alias("least"), F.count("doc_id").alias("n")).where("n > 0")
    touched = staged(touched.select("component", "least"), "forest-least")
    return strict.join(small(touched), "component", "left").select("node", F.coalesce("least", "component").alias("component"))


def _near_duplicates(rows: DataFrame, k: int, percent: int) -> DataFrame:
    sketched = staged(sketches(rows, k), "forest-sketches")
    usable = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    distinct = staged(_distinct_sets(usable), "forest-nodes")
    found = staged(_candidates(distinct.select("rep", "signature")), "forest-found")
    pairs = staged(found.where("pair").select("a", "b").distinct(), "forest-pairs")
    ids = staged(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "forest-ids")
    wanted = distinct.drop("signature").join(small(ids, 5 * BROADCAST_ROWS), "rep", "left_semi")
    sets = _sets(rows, wanted, k)
    member = staged(usable.select("doc_id", *SET).join(distinct.select(*SET, "rep"), [*SET]).select("doc_id", "rep"), "forest-members")
    links = staged(_confirmed(pairs, sets, percent), "forest-links").union(_one_key(member)).distinct()
    strict = connected_components(links)
    more = staged(_last_links(connected_components(found.where("loose").select("a", "b")), strict, sets, percent), "forest-last")
    if not more.isEmpty():
        strict = connected_components(strict.select("node", "component").union(more), "node", "component")
    strict = _least_keys(strict, distinct)
    # Equal sets under several keys: each document's set leads to its representative, that to its component.
    member = member.join(strict.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    member = member.groupBy("doc_id").agg(F.min("component").alias("component"))
    component = F.coalesce("component", "doc_id")
    return sketched.join(member, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all columns, but one row of each group: that with the least key.  Rows without a key all stay."""
    found = near_duplicates(docs, key, text)
    dropped = staged(found.where(~F.col("kept")).select(F.col("doc_id").alias("__dropped")).distinct(), "forest-dropped")
    kept = docs.join(small(dropped, 5 * BROADCAST_ROWS), docs[key] == F.col("__dropped"), "left_anti")
    repeated = staged(docs.groupBy(F.col(key).alias("__repeated")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND __repeated IS NOT NULL").select("__repeated"), "forest-repeated")
    if repeated.isEmpty():
        return kept
    twice = kept[key] == F.col("__repeated")
    return kept.join(small(repeated), twice, "left_anti").union(kept.join(small(repeated), twice, "left_semi").dropDuplicates([key]))
