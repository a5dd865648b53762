"""Jaccard join of documents on word shingles by T-occurrence search.

A pair with Jaccard similarity t shares at least t * n of the n shingles of either side.  Shingles
have one order for all documents, common ones last.  The first n - ceil(t * n) + l of a document
are its short inverted lists, the others its long ones: a partner occurs on at least l of the
short lists, which are merged, and is then probed on the long ones by binary search.

Copies of one shingle set are one representative.  Blocks of documents learn which of their short
lists hold any second document; a document with too few such lists has no partner and is done.
In the lists that are left only a few pivots are queries at first, so a list costs its length, not
its square; the first pivot is the member with the fewest shingles of its own, the middle of its
group.  Members linked to a pivot join its component.  Only members of lists that still hold
different components are queries again, and then by what can link them: shingles that documents
of several components hold.  Who has too few of those is done, the others have few short lists.
Documents around one pivot share nearly all, which tells nothing, so they are searched by what
sets them apart: their differences from the shingles that most of them hold.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalfold.llm.components import components, stored
from signalfold.llm.words import blank_joined, chunks, hash_runs, hash_slices, mix
from signalfold.llm.worker import freed, giving_back
from signalfold.scale import broadcast_if_small

WIDTH = 5
PERCENT = 75
BLOCK_BYTES = 8 << 20
SHARD_TOKENS = 3_000_000
OFTEN = 4  # documents of one batch that share a shingle before it is reported as common
PIVOTS = 3  # most members of a list that meet all its others at first; a list of 2**k has k of them
BEST = 2  # pivots that a document is compared with at first; further links are found among open documents
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each UTF-8 text; A-Z count as a-z."""
    words, sizes = blank_joined([t and t.lower() for t in texts])
    flat = hash_slices(words)
    runs, out, at = hash_runs(flat, width), [], 0
    for n in sizes.tolist():
        if n >= width:
            out.append(np.unique(runs[at : at + n - width + 1]))
        else:
            out.append(hash_runs(flat[at : at + n], n) if n else np.zeros(0, np.uint64))
        at += n
    return out


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The texts of a column one by one as bytes, which take no room beside the column all at once."""
    return (text.as_py() for text in column.cast(pa.binary()))


def least_shared(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n shares at least with any partner."""
    return -(-percent * n // 100)


def needed(n: int) -> int:
    """Short lists on which a partner of a set of n must occur, from its own side."""
    return 1 + n // 20


def short_lists(tokens: np.ndarray, common: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The rarest shingles of a sorted set that must be merged; common ones come last in the order."""
    n = len(tokens)
    take = min(n, n - least_shared(n, percent) + needed(n))
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        rank = np.where(common[at] == tokens, counts[at], 0)
        if rank.any():
            return tokens[np.argsort(rank, kind="stable")[:take]]
    return tokens[:take]


def merge_short(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """T-occurrence by heap: members of at least `need` of the sorted lists, with their number of lists."""
    found = ((m, sum(1 for _ in same)) for m, same in groupby(heapq.merge(*lists)))
    return [(m, n) for m, n in found if n >= need]


def probe_long(small: np.ndarray, large: np.ndarray, reach: int, step: int = 256) -> bool:
    """True if the sorted sets share `reach` entries; binary search, given up once out of reach."""
    if len(small) > len(large):
        small, large = large, small
    shared = 0
    for at in range(0, len(small), step):
        if shared + len(small) - at < reach:
            return False
        part = small[at : at + step]
        shared += int(np.count_nonzero(large[np.minimum(np.searchsorted(large, part), len(large) - 1)] == part))
    return shared >= reach


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, n, s1, s2) per document, and rows (token, often) for shingles common in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, texts in chunks(utf8(batch.column(1))):
                sets = shingle_sets(texts, width)
                flat = np.concatenate(sets)
                sizes = np.array([len(s) for s in sets], np.int64)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(flat ^ x))]) for x in (np.uint64(0), _OTHER)]
                ends = np.cumsum(sizes)
                s1, s2 = ((s[ends] - s[ends - sizes]).view(np.int64) for s in sums)
                values, times = np.unique(flat, return_counts=True)
                some = times >= OFTEN
                n, m = len(texts), int(some.sum())
                ids = batch.column(0).slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([ids, pa.nulls(m, pa.int64())])]
                    + [pa.concat_arrays([pa.array(a), pa.nulls(m, pa.int64())]) for a in (sizes, s1, s2)]
                    + [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(a)]) for a in (values[some].view(np.int64), times[some])],
                    names=["doc_id", "n", "s1", "s2", "token", "often"],
                )

    return docs.mapInArrow(giving_back(run), "doc_id long, n long, s1 long, s2 long, token long, often long")


def _common(signed: DataFrame, share: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than a share of all documents, sorted, and their counts.

    A document of n shingles adds n, so at most (mean n) / share of them come back, whatever the
    size of the input.  They only order the lists.
    """
    total = signed.where("token is null").count()
    counted = signed.where("token is not null").groupBy("token").agg(F.sum("often").alias("often"))
    rows = counted.where(F.col("often") > share * total).collect()
    tokens = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r["often"] for r in rows], np.int64)[order]


def _survivors(docs: DataFrame, reps: DataFrame, blocks: int, shards: int, common, counts, width: int, percent: int) -> DataFrame:
    """Representatives that may have a partner: doc_id, n, their shared short lists and their whole set.

    `own` is the share of their shingles that are short lists of no other document.
    """
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks))
    dealt = docs.withColumn("block", block).repartition("block")
    wanted = reps.withColumnRenamed("rep", "doc_id").select(block.alias("block"), "doc_id")

    def sets_of(rows: pa.Table, ids: set) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        pairs = {}
        for doc_id, text in zip(rows.column("doc_id").to_pylist(), utf8(rows.column("text")), strict=True):
            if doc_id in ids and (doc_id not in pairs or (text or b"") < pairs[doc_id]):
                pairs[doc_id] = text or b""
        order = sorted(pairs)
        sets = [s for _, _, texts in chunks([pairs[i] for i in order]) for s in shingle_sets(texts, width)]
        return order, sets, [short_lists(s, common, counts, percent) for s in sets]

    def dealt_tokens(short: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        flat = np.concatenate(short) if short else np.zeros(0, np.uint64)
        tokens, back, times = np.unique(flat, return_inverse=True, return_counts=True)
        return tokens, (mix(tokens) % np.uint64(shards)).astype(np.int64), back, times

    def send(rows: pa.Table, right: pa.Table) -> pa.Table:
        ids = set(right.column("doc_id").to_pylist())
        out = []
        if rows.num_rows and ids:
            tokens, shard, _, times = dealt_tokens(sets_of(rows, ids)[2])
            block = right.column("block")[0].as_py()
            order = np.argsort(shard, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                # 32 of the bits are enough here: a clash only lets a list pass as shared.
                raw = (tokens[part] >> np.uint64(32)).astype("<u4").tobytes()
                out.append((int(shard[part[0]]), block, raw, np.packbits(times[part] > 1).tobytes()))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "block", "tokens", "twice"])

    def count(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(t, "<u4") for t in rows.column("tokens").to_pylist()]
        flat = np.concatenate(parts)
        order = np.argsort(flat, kind="stable")
        same = flat[order][1:] == flat[order][:-1]
        shared = np.zeros(len(flat), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        out, at = [], 0
        for part, twice in zip(parts, rows.column("twice").to_pylist(), strict=True):
            own = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(part)).astype(bool)
            out.append(zlib.compress(np.packbits(shared[at : at + len(part)] | own).tobytes(), 1))
            at += len(part)
        return pa.table({"block": rows.column("block"), "doc_id": pa.nulls(len(out), pa.int64()), "shard": rows.column("shard"), "bits": pa.array(out)})

    def keep(rows: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        ids = {i for i in right.column("doc_id").to_pylist() if i is not None}
        if rows.num_rows and ids:
            order, sets, short = sets_of(rows, ids)
            tokens, shard, back, _ = dealt_tokens(short)
            shared = np.zeros(len(tokens), bool)
            for to, bits in zip(right.column("shard").to_pylist(), right.column("bits").to_pylist(), strict=True):
                if to is not None:
                    mine = np.flatnonzero(shard == to)
                    shared[mine] = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(mine))
            at = 0
            for doc_id, whole, lists in zip(order, sets, short, strict=True):
                mine = back[at : at + len(lists)]
                at += len(lists)
                lists = tokens[mine[shared[mine]]]
                # The smallest possible partner asks for the fewest common lists.
                if len(lists) >= needed(least_shared(len(whole), percent)):
                    own = (len(mine) - len(lists)) / len(whole)
                    found.append((doc_id, len(whole), own, lists.view(np.int64), np.sort(whole.view(np.int64))))
        columns = list(zip(*found, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n", "own", "lists", "tokens"])

    left = dealt.groupBy("block")
    sent = left.cogroup(wanted.groupBy("block")).applyInArrow(lambda rows, right: freed(send, rows, right), "shard long, block long, tokens binary, twice binary")
    answers = sent.groupBy("shard").applyInArrow(lambda rows: freed(count, rows), "block long, doc_id long, shard long, bits binary")
    right = answers.unionByName(wanted.withColumns({"shard": F.lit(None).cast("long"), "bits": F.lit(None).cast("binary")}))
    return left.cogroup(right.groupBy("block")).applyInArrow(
        lambda rows, right: freed(keep, rows, right), "doc_id long, n long, own double, lists array<long>, tokens array<long>"
    )


def _open_sets(left: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """Documents that may still link to another component: doc_id, n, component, ref, s, lists.

    Such a document is on as many lists that hold several components as a link takes, and what it shares
    with a partner there are shingles that are found in several components: `lists`, s of its n shingles,
    as structs (size, token), the rarest first.  `ref` is the pivot of most of its open lists.
    """
    several = F.min("component").alias("low"), F.max("component").alias("high")
    pivot = F.min(F.struct("own", "doc_id"))["doc_id"].alias("pivot")
    # As in `needed`, for the smallest possible partner: it is on so many of the short lists.
    enough = F.col("lists") >= 1 + F.floor(F.ceil(percent * F.col("n") / 100) / 20)
    mixed = postings.groupBy("token").agg(*several, pivot).where("low <> high").select("token", "pivot")
    met = postings.join(mixed, "token").groupBy("doc_id", "component", "n").agg(F.mode("pivot", True).alias("ref"), F.count("*").alias("lists"))
    open_ = stored(met.where(enough).select("doc_id", "n", "component", "ref"), "open-documents")
    whole = left.select("doc_id", "tokens").join(broadcast_if_small(open_.select("doc_id", "component")), "doc_id")
    whole = whole.select("doc_id", "component", F.explode("tokens").alias("token"))
    shared = whole.groupBy("token").agg(*several, F.count("*").alias("size")).where("low <> high").select("token", "size")
    lists = F.sort_array(F.collect_list(F.struct("size", "token"))).alias("lists")
    sets = whole.select("doc_id", "token").join(shared, "token").groupBy("doc_id").agg(lists).join(open_, "doc_id")
    sets = sets.select("doc_id", "n", "component", "ref", "lists", F.size("lists").cast("long").alias("s"))
    return sets.where(100 * F.col("s") >= percent * F.col("n"))


def _differences(sets: DataFrame) -> DataFrame:
    """Adds to open sets: core, missing and extra.

    `core` has the shingles that more than half of the documents of a `ref` hold; a document has
    `extra` ones beside it and misses some.  Where it holds less of the core than it differs, all
    of these and its ref are null: then its differences tell no more than its shingles.
    """
    size = sets.groupBy("ref").agg(F.count("*").alias("members"))
    held = sets.select("ref", F.explode("lists.token").alias("token")).groupBy("ref", "token").agg(F.count("*").alias("times"))
    core = held.join(size, "ref").where("2 * times > members").groupBy("ref").agg(F.collect_list("token").alias("core"))
    near = sets.join(core, "ref", "left").withColumns({
        "missing": F.array_except("core", "lists.token"), "extra": F.array_except("lists.token", "core"),
    })
    close = F.size("missing") + F.size("extra") <= F.size("core") - F.size("missing")
    return near.withColumns({c: F.when(close, F.col(c)) for c in ("ref", "core", "missing", "extra")})


def _pairs_around_refs(near: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one ref and different components that link, by their differences.

    Of a core of c shingles x and y share c - missing(x) - missing(y) + o, where o counts the
    differences they have in common.  So they link when w(x) + w(y) <= (100 + percent) * (c + o),
    with w = percent * n + (100 + percent) * missing.  Pairs for which o = 0 is enough all link to
    the document of the least w as well, and that star replaces them; other pairs have a
    difference in common, and counting those gives o.
    """
    whole = 100 + percent
    docs = near.where("ref is not null").select(
        "ref", "doc_id", "component", F.size("core").alias("c"), F.size("missing").alias("m"), F.size("extra").alias("e"),
        (percent * F.col("n") + whole * F.size("missing")).alias("w"), "missing", "extra",
    )
    middle = docs.groupBy("ref").agg(F.min(F.struct("w", "doc_id", "component")).alias("mid"))
    star = docs.join(middle, "ref").where((F.col("component") != F.col("mid.component")) & (F.col("w") + F.col("mid.w") <= whole * F.col("c")))
    facts = ["ref", "doc_id", "component", "c", "m", "e", "w"]
    apart = docs.select(*facts, F.lit(False).alias("has"), F.explode("missing").alias("token")).unionByName(
        docs.select(*facts, F.lit(True).alias("has"), F.explode("extra").alias("token"))
    )
    other = apart.select("ref", "has", "token", *[F.col(x).alias(f"{x}2") for x in ("doc_id", "component", "m", "e", "w")])
    both, most = F.col("w") + F.col("w2"), F.least("m", "m2") + F.least("e", "e2")
    open_ = (F.col("doc_id") < F.col("doc_id2")) & (F.col("component") != F.col("component2"))
    met = apart.join(other, ["ref", "has", "token"]).where(open_ & (both > whole * F.col("c")) & (both <= whole * (F.col("c") + most)))
    shared = met.groupBy(F.col("doc_id").alias("a"), F.col("doc_id2").alias("b"), (both - whole * F.col("c")).alias("lacks")).count()
    found = shared.where(whole * F.col("count") >= F.col("lacks")).select("a", "b")
    return found.unionByName(star.select(F.least("doc_id", "mid.doc_id").alias("a"), F.greatest("doc_id", "mid.doc_id").alias("b")))


def _short_of_open(near: DataFrame, percent: int) -> DataFrame:
    """The short lists of open sets: a link takes `least_shared(n)` of the s shingles, the rest counts no more."""
    least = F.ceil(percent * F.col("n") / 100)
    take = F.col("s") - least + 1 + F.floor(F.col("n") / 20)  # as in `needed`
    return near.select("doc_id", "n", "s", "component", "ref", F.explode(F.slice("lists", F.lit(1), take.cast("int"))["token"]).alias("token"))


def _candidates(postings: DataFrame, full: bool, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b), a < b, of documents of different components that share enough short lists.

    `postings` has doc_id, n, s (shingles that a partner can hold), token and component, without
    `full` also own.  First every list has a few pivots (its least members in as many orders),
    each of which meets all members; a member is paired with the pivots of most of its lists.
    With `full`, members meet those of other components and another ref in what lists still hold
    several; then all common lists of a pair are there and the bound applies to their sum: the
    lists of one pair may be merged in several tasks, and with either side as the query.
    """
    aggregates = [F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")]
    if full:
        aggregates.append(F.mode("ref", True).alias("most"))
    else:
        orders = [F.col("own"), *(F.xxhash64("doc_id", F.lit(i)) for i in range(1, PIVOTS))]
        aggregates += [F.min(F.struct(o.alias("turn"), "doc_id", "n")).alias(f"p{i}") for i, o in enumerate(orders)]
    lists = postings.groupBy("token").agg(*aggregates).where("low <> high")
    member = postings.select("token", "doc_id", "component", "n", "s", *(["ref"] if full else []))
    if full:
        # Members of the ref that most of a list have do not meet each other here.
        query = member.join(lists.select("token", "size", "most"), "token").where(~F.col("ref").eqNullSafe(F.col("most")) | F.col("most").isNull())
        query = query.select(
            "token", "size", "most", F.col("doc_id").alias("q"), F.col("n").alias("nq"), F.col("s").alias("sq"),
            F.col("component").alias("cq"), F.col("ref").alias("rq"),
        )
        once = (F.col("q") < F.col("doc_id")) | F.coalesce(F.col("ref") == F.col("most"), F.lit(False))
        other = (F.col("cq") != F.col("component")) & once & ~F.coalesce(F.col("rq") == F.col("ref"), F.lit(False))
    else:
        all_ = F.array(*[F.struct(f"p{i}.doc_id", f"p{i}.n") for i in range(PIVOTS)])
        pivots = F.array_distinct(F.slice(all_, F.lit(1), F.least(F.lit(PIVOTS), F.ceil(F.log2("size")).cast("int"))))
        query = lists.select("token", "size", F.explode(pivots).alias("p")).select(
            "token", "size", F.col("p.doc_id").alias("q"), F.col("p.n").alias("nq"), F.col("p.n").alias("sq")
        )
        other = F.col("q") != F.col("doc_id")
    # No more than min(s) of the shingles can be shared; this holds the sizes together as well.
    sized = (100 + percent) * F.least("s", "sq") >= percent * (F.col("n") + F.col("nq"))
    met = member.join(query, "token").where(other & sized)
    # A query with long lists is dealt out by its partners, so that none is merged in one task.
    salt = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), (F.col("size") / 300).cast("int")))
    rows = met.select(F.col("q").alias("a"), F.col("nq").alias("na"), "token", F.col("doc_id").alias("b"), F.col("n").alias("nb"), salt.alias("salt"))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "token", "b")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(query: int, na: int, lists: list[list[int]], sizes: dict[int, int]) -> list[tuple[int, int, int, int]]:
            return [(query, b, k, min(needed(na), needed(sizes[b]))) for b, k in merge_short(lists, 1)]

        def out(pairs: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            columns = list(zip(*pairs, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["a", "b", "lists", "need"])

        query, na, token, lists, sizes, done = None, 0, None, [], {}, []
        for batch in batches:
            for a, size, t, b, nb in zip(*[batch.column(c).to_pylist() for c in ("a", "na", "token", "b", "nb")], strict=True):
                if a != query:
                    if lists:
                        done += answer(query, na, lists, sizes)
                    query, na, token, lists, sizes = a, size, None, [], {}
                if t != token:
                    token = t
                    lists.append([])
                lists[-1].append(b)
                sizes[b] = nb
            yield out(done)
            done = []
        if lists:
            yield out(answer(query, na, lists, sizes))

    found = rows.mapInArrow(giving_back(merge), "a long, b long, lists long, need long")
    if not full:
        # What is left out here meets again among the open documents.
        turn = Window.partitionBy("b").orderBy(F.desc("lists"), "a")
        best = found.groupBy("a", "b").agg(F.sum("lists").alias("lists")).withColumn("turn", F.row_number().over(turn))
        return best.where(F.col("turn") <= BEST).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "lists", "need")
    return found.groupBy("a", "b", "need").agg(F.sum("lists").alias("lists")).where("lists >= need").select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (a table of files) that reach the similarity."""
    # Pairs are two numbers, sets are long: where the pairs are small, only sets that are asked for travel.
    pairs = broadcast_if_small(pairs)
    one = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb")).join(pairs.select("b"), "b", "left_semi")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("ta"), batch.column("tb"))]
            good = []
            for i in range(batch.num_rows):
                x, y = (v[o[i] : o[i + 1]] for v, o in flat)
                # shared / (x + y - shared) reaches percent / 100
                good.append(probe_long(x, y, -(-percent * (len(x) + len(y)) // (100 + percent))))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").mapInArrow(giving_back(check), "a long, b long")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least id reachable by links).

    Documents link when 100 * shared shingles >= percent * all shingles.  Null, empty and blank
    texts have no shingles and no links, a text of fewer than `width` words is one shingle.  Ids
    are taken to be unique; of rows that repeat an id each is returned, and they share their
    component.  Rows with a null id link with nothing and have a null component.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(_signatures(base, width), "signatures")
    facts = signed.where("token is null").select("doc_id", "n", "s1", "s2")
    size = base.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    common, counts = _common(signed)
    reps = facts.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    shards = 1 + size // 20 // SHARD_TOKENS  # about a twentieth of the bytes are short lists
    named = base.where("doc_id is not null")
    left = stored(_survivors(named, reps.select("rep").distinct(), size // block_bytes + 1, shards, common, counts, width, percent), "survivors")
    sets = left.select("doc_id", "tokens")
    postings = left.select("doc_id", "n", "own", F.explode("lists").alias("token"))
    pairs = stored(_candidates(postings.withColumns({"component": F.col("doc_id"), "s": F.col("n")}), full=False, percent=percent), "pairs")
    links = stored(_linked(pairs, sets, percent), "links")
    known = components(links)
    now = postings.join(known, F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id"))
    near = stored(_differences(stored(_open_sets(left, now, percent), "open-sets")), "near")
    again = _candidates(_short_of_open(near, percent), full=True, percent=percent).unionByName(_pairs_around_refs(near, percent))
    pairs = stored(again.join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = stored(_linked(pairs, sets, percent), "links")
    if not more.isEmpty():
        known = components(links.unionByName(more))
    ids = facts.select("doc_id", F.col("n").alias("n_shingles"), "n", "s1", "s2").where("doc_id is not null")
    placed = ids.join(reps, ["n", "s1", "s2"], "left").join(known, F.col("rep") == F.col("node"), "left")
    placed = placed.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    nameless = facts.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return placed.unionByName(nameless)
