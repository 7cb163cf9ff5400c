"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A document is a weighted set: its shingles of five words with their counts. A
ProbMinHash signature is the race of exponential arrivals: each shingle sends a
Poisson process of rate equal to its weight, every arrival falls on a random
component, and the first arrival of a component wins it. Arrivals beyond a time
after which no component can change hands are never drawn. Two signatures agree
on a component with the probability Jaccard similarity of the sets.

Documents of the same word sequence are one node. Bands of the signature give
buckets; no bucket is expanded into all its pairs. Each is first compared with its
most central member (the one that shares most buckets with others), then with a
second. Pairs of members that are then still in different components meet through
signatures of 2048 components, two bits each, as matrices of bounded chunks, and those that
agree enough (six standard errors below the threshold) are compared too. So a
group of n copies costs about n comparisons of texts, no candidate is capped, and
links are only ever made by exact comparison of whole texts. Components come from
alternating large and small stars. What is joined by a bucket, a text, a pivot or a
component of very many rows is dealt in parts by a salt.

Texts with fewer than five words are one shingle of all their words; very long texts
are compared whole. Edge cases: null, empty and blank texts are classes of their own;
rows of a null id take no part in linking and get a null class; equal rows share a
class; texts of one id are nodes each, so its rows may be of different classes (two
classes whose least id is the same have one ``class_id``); a class is named by its
least id, whatever the ties; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_batches, byte_words, claim, each_salt, materialize, owns, salt, salts_held


@dataclass(frozen=True)
class Near:
    words: int = 5
    similarity: float = 0.8
    bands: int = 26
    rows: int = 5
    #: Rounds of comparing buckets with one member, before what remains.
    pivots: int = 2
    #: Components of the second signature, for what pivots leave, the standard errors
    #: below the asked similarity at which a pair is still compared, and members of a chunk.
    long: int = 2048
    margin: float = 6.0
    chunk: int = 256
    #: Bytes of a batch that a Python worker gets.
    batch: int = 8_000_000


_G = np.uint64(0x9E3779B97F4A7C15)
_WORDS: dict[bytes, int] = {}
owns("neardup", _WORDS.clear)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = x + _G
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    if len(word) <= 64:
        if len(_WORDS) > 150_000:
            _WORDS.clear()
        _WORDS[word] = h
    return h


def shingles(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending 64-bit hashes of the word shingles, and their counts."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    known = _WORDS.get
    h = np.array([x if (x := known(w)) is not None else _word_hash(w) for w in words], np.uint64)
    width = min(width, len(h))
    n = len(h) - width + 1
    code = h[:n].copy()
    for j in range(1, width):
        code = code * np.uint64(0xD1342543DE82EF95) + h[j : j + n]
    return np.unique(_mix(code), return_counts=True)


def prob_minhash(items: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """The item that wins each component; ``items`` must not be empty."""
    w = weights.astype(float)
    until = size * (np.log(size) + 3.0) / w.sum()
    while True:
        at, own, begun = np.arange(len(items)), w, np.zeros(len(items))
        step, drawn, times, where, who = max(1, int(until * w.mean()) + 1), 0, [], [], []
        while len(at):
            turn = (np.arange(drawn, drawn + step, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
            r = _mix(items[at][:, None] ^ turn)
            gap = -np.log(((r >> np.uint64(11)).astype(float) + 1.0) * 2.0**-53)
            t = begun[:, None] + np.cumsum(gap, axis=1) / own[:, None]
            i, j = np.nonzero(t <= until)
            times.append(t[i, j])
            where.append((_mix(r[i, j] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(size)).astype(np.int64))
            who.append(at[i])
            more = t[:, -1] <= until
            at, own, begun = at[more], own[more], t[more, -1]
            drawn += step
        t, k, e = np.concatenate(times), np.concatenate(where), np.concatenate(who)
        last = np.argsort(-t)  # of equal components, the earliest arrival is written last
        winner = np.full(size, -1)
        winner[k[last]] = e[last]
        if (winner >= 0).all():
            return items[winner]
        until *= 1.7  # some component had no arrival yet


def prob_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets.

    Sum over shared i of 1 / sum over j of max(a_j / a_i, b_j / b_i), with one sort
    by the ratio of weights.
    """
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    until = np.searchsorted(ratio, ratio, side="right")
    below = np.concatenate([[0.0], np.cumsum(x)])[until]  # b_j / a_j <= b_i / a_i: a's side is the larger
    above = y.sum() - np.concatenate([[0.0], np.cumsum(y)])[until]
    return float((1.0 / ((below + only_a) / x + (above + only_b) / y)).sum())


def node_of(words: list[bytes]) -> bytes | None:
    """Hash of the word sequence; None without words."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def digests(texts: list[str | None], how: Near) -> pa.Array:
    """Node and band hashes of each text; both null without words."""
    nodes, winners = [], []
    for t in texts:
        words = byte_words(t)
        nodes.append(node_of(words))
        if words:
            winners.append(prob_minhash(*shingles(words, how.words), how.bands * how.rows))
    rows = np.array(winners, np.uint64).reshape(len(winners), how.bands, how.rows)
    code = np.broadcast_to(np.arange(how.bands, dtype=np.uint64), rows.shape[:2])
    for j in range(how.rows):
        code = _mix(code ^ rows[:, :, j])
    has = np.array([n is not None for n in nodes], bool)
    ends = np.concatenate([[0], np.cumsum(np.where(has, how.bands, 0))]).astype(np.int32)
    bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(code.view(np.int64).reshape(-1)), mask=pa.array(~has))
    return pa.StructArray.from_arrays([pa.array(nodes, pa.binary()), bands], names=["node", "bands"])


def sign(docs: DataFrame, how: Near, text: str, key: str) -> DataFrame:
    """``doc_id, row, node, bands``: ``row`` hashes all columns, ``node`` is the hash of the word sequence."""

    @F.arrow_udf("node binary, bands array<long>")
    def run(col: pa.Array) -> pa.Array:
        claim("neardup")
        return digests(col.to_pylist(), how)

    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(F.col(key).cast("long").alias("doc_id"), row.alias("row"), run(F.col(text)).alias("s")).select("doc_id", "row", "s.node", "s.bands")


def compare(pairs: DataFrame, texts: DataFrame, how: Near) -> DataFrame:
    """Of ``a, b`` pairs, those at least as similar as asked. The pairs of a ``b`` are
    dealt by ``a``, so a ``b`` of very many pairs goes to several tasks; its text goes
    there once for each part that has a pair."""
    dealt = pairs.withColumn("salt", salt("a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb")).join(dealt.select("b", "salt").distinct(), "b")
    both = dealt.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(right, ["b", "salt"])
    width, least = how.words, how.similarity - 1e-9

    @F.arrow_udf("boolean")
    def alike(ta: pa.Array, tb: pa.Array) -> pa.Array:
        claim("neardup")
        kept: OrderedDict[str, tuple] = OrderedDict()

        def of(t: str) -> tuple:
            s = kept.pop(t, None)
            if s is None:
                s = shingles(byte_words(t), width)
            kept[t] = s
            if len(kept) > 32:
                kept.popitem(last=False)
            return s

        return pa.array([prob_jaccard(of(x), of(y)) >= least for x, y in zip(ta.to_pylist(), tb.to_pylist(), strict=True)], pa.bool_())

    return both.where(alike("ta", "tb")).select("a", "b")


def two_bits(winners: np.ndarray) -> bytes:
    """The low two bits of each component; their number is a multiple of 32."""
    q = (winners & np.uint64(3)).astype(np.uint8).reshape(-1, 4)
    return (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).astype(np.uint8).tobytes()


def differing(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Of each row of packed signatures, how many components differ from ``one``'s."""
    d = rows ^ one
    d = (d | d >> np.uint64(1)) & np.uint64(0x5555555555555555)
    return np.bitwise_count(d).sum(axis=1, dtype=np.int64)


def remaining(members: DataFrame, texts: DataFrame, nodes: DataFrame, how: Near, keep) -> DataFrame:
    """Pairs ``a, b`` of a bucket whose roots differ and whose long signatures agree
    on a share that leaves the asked similarity likely.

    Members get a signature of two bits of ``how.long`` components, and chunks of at most some
    ``how.chunk`` members meet as matrices, so pairs that fail are never rows.
    Every two chunks that meet are a row of their own, dealt by bucket and chunk. A pair
    that shares several buckets comes from the first of them only.
    """
    size, width = how.long, how.words
    agree = how.similarity + (1 - how.similarity) / 4  # two bits of different components are equal in a fourth of cases
    least = agree - how.margin * (agree * (1 - agree) / size) ** 0.5

    @F.arrow_udf("binary")
    def long_signature(col: pa.Array) -> pa.Array:
        return pa.array([two_bits(prob_minhash(*shingles(byte_words(t), width), size)) for t in col.to_pylist()], pa.binary())

    ids = members.select("id").distinct()
    signed = keep(texts.join(ids, "id", "left_semi").select("id", long_signature("text").alias("bytes")).join(nodes.select("id", "bands"), "id"), "near-long")
    # A component with many members of a bucket has chunks of its own; the others' members share some.
    held = members.withColumn("salt", salt("id"))
    counts = keep(held.groupBy("bucket", "root").agg(F.count("*").alias("n"), salts_held().alias("bits")), "near-counts")
    parts = lambda n: F.ceil(n / how.chunk).cast("int")
    few = counts.where(F.col("n") < how.chunk)
    shared = _of_key(few, few.groupBy("bucket").agg(parts(F.sum("n")).alias("parts")), "bucket", "root")
    labels = counts.where(F.col("n") >= how.chunk).select("bucket", "root", F.col("root").alias("of"), parts(F.col("n")).alias("parts"), "bits")
    labels = labels.unionByName(shared.select("bucket", "root", F.lit(-1).cast("long").alias("of"), "parts", "bits")).withColumn("salt", each_salt("bits"))
    chunk = F.struct("of", F.pmod(F.xxhash64(F.lit(7), "id"), F.col("parts")).cast("int").alias("part"))
    dealt = held.join(labels, ["bucket", "root", "salt"]).select("bucket", chunk.alias("chunk"), "id", "root").join(signed, "id")
    packed = keep(dealt.groupBy("bucket", "chunk").agg(F.collect_list(F.struct("id", "root", "bytes", "bands")).alias("ms")), "near-chunks")  # a chunk is bounded
    # Which chunks meet is worked out without their members: none with another of the same component.
    names = packed.select("bucket", "chunk").join(counts.groupBy("bucket").agg(F.count("*").alias("roots")).where("roots > 1"), "bucket", "left_semi")
    meets = names.select("bucket", F.col("chunk").alias("i")).join(names.select("bucket", F.col("chunk").alias("j")), "bucket")
    meets = keep(meets.where((F.col("i") <= F.col("j")) & ~((F.col("i.of") == F.col("j.of")) & (F.col("i.of") >= 0))), "near-meets")
    left = meets.join(packed.select("bucket", F.col("chunk").alias("i"), F.col("ms").alias("x")), ["bucket", "i"])
    both = left.join(packed.select("bucket", F.col("chunk").alias("j"), F.col("ms").alias("y")), ["bucket", "j"])
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def side(col: pa.ListArray, at: int) -> tuple[np.ndarray, ...]:
        ms = col[at].values
        raw = b"".join(ms.field("bytes").to_pylist())
        return ms.field("id").to_numpy(), ms.field("root").to_numpy(), np.frombuffer(raw, np.uint64).reshape(len(ms), -1), ms.field("bands").flatten().to_numpy().reshape(len(ms), -1)

    def meet(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                bucket, same = batch.column("bucket")[at].as_py(), batch.column("same")[at].as_py()
                (ia, ra, sa, ba), (ib, rb, sb, bb) = side(batch.column("x"), at), side(batch.column("y"), at)
                band = int(np.flatnonzero(ba[0] == bucket)[0])
                found = []
                for k in range(len(ia)):
                    other = np.flatnonzero((rb != ra[k]) & ((ib < ia[k]) if same else True))
                    if len(other):
                        hit = other[size - differing(sb[other], sa[k]) >= least * size]
                        hit = hit[~(bb[hit, :band] == ba[k, :band]).any(axis=1)]
                        found.append((np.maximum(ib[hit], ia[k]), np.minimum(ib[hit], ia[k])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=kind)

    return both.select("bucket", (F.col("i") == F.col("j")).alias("same"), "x", "y").mapInArrow(meet, "a long, b long")


def components(edges: DataFrame, keep, name: str = "near") -> DataFrame:
    """``id, root``: the least id of the component of each id in ``a, b`` links."""
    low = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-links")
    while True:
        # Large star: larger neighbours point to the least of the neighbourhood.
        both = low.unionByName(low.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _of_key(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: smaller neighbours and the node itself point to the least.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _of_key(large, least, "u", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = keep(small, f"{name}-stars")
        # Done when all is stars: nobody points to two, or to one that points itself.
        ends = low.select(F.col("u").alias("x"), F.lit(1).alias("from"), F.lit(0).alias("to")).unionByName(low.select(F.col("v").alias("x"), F.lit(0).alias("from"), F.lit(1).alias("to")))
        if ends.groupBy("x").agg(F.sum("from").alias("n"), F.max("to").alias("to")).where("n > 1 or n = 1 and to = 1").isEmpty():
            break
    return low.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(low.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _of_key(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Joins ``rows`` with the one row that ``table`` has for their key. Rows of a hot
    key are dealt by ``by``, and the row is repeated for each part."""
    salted = rows.withColumn("salt", salt(by))
    held = salted.groupBy(key).agg(salts_held().alias("__bits"))
    spread = table.join(held, key).withColumn("salt", each_salt("__bits")).drop("__bits")
    return salted.join(spread, [key, "salt"], how).drop("salt")


def texts_of(docs: DataFrame, need: DataFrame, text: str, key: str) -> DataFrame:
    """``id, text`` of each row of ``need`` (``id, node, rep``): a text of that node under the id ``rep``."""

    @F.arrow_udf("binary")
    def node(col: pa.Array) -> pa.Array:
        claim("neardup")
        return pa.array([node_of(byte_words(t)) for t in col.to_pylist()], pa.binary())

    # The join asks for nodes that aren't null. As a filter on a deterministic function that would run it a second
    # time, over all documents and in a second Python worker of each task, which then stays for the session.
    node = node.asNondeterministic()
    own = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text")).join(need.select("rep").distinct(), "rep", "left_semi").where(F.col("text").isNotNull())
    return own.select(node("text").alias("node"), "text").join(need, "node").select("id", "text").dropDuplicates(["id"])


def _linked(docs: DataFrame, signed: DataFrame, how: Near, text: str, key: str, keep) -> DataFrame:
    """``node, id, rep, root``: each word sequence with the least document id that has
    it, and the component it belongs to. Ids are numbers of word sequences."""
    found = signed.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"))
    # A number for each that doesn't change any more; in the order of rep, so the least of a component has its least document.
    nodes = keep(found.repartitionByRange("rep", "node").sortWithinPartitions("rep", "node").withColumn("id", F.monotonically_increasing_id()), "near-nodes")
    banded = nodes.select("id", F.explode("bands").alias("bucket")).withColumn("salt", salt("id"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size"), salts_held().alias("bits")).where("size > 1").select("bucket", "size", each_salt("bits").alias("salt"))
    members = keep(banded.join(shared, ["bucket", "salt"]).select("bucket", "salt", "id", "size"), "near-members")
    mass = members.groupBy("id").agg(F.sum("size").alias("mass"))
    members = keep(members.join(mass, "id").select("bucket", "salt", "id", "mass"), "near-members")
    need = keep(nodes.join(mass, "id", "left_semi").select("id", "node", "rep"), "near-need")
    texts = keep(texts_of(docs, need, text, key), "near-texts")

    links, roots, placed = None, None, members.withColumn("root", F.col("id"))
    for turn in range(how.pivots + 1):
        # What each bucket with several components has: its most central member and its parts.
        central = F.max(F.struct("mass", (-F.col("id")).alias("minus"), "root")).alias("c")
        undone = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), central, salts_held().alias("bits")).where("lo <> hi")
        undone = undone.select("bucket", (-F.col("c.minus")).alias("b"), F.col("c.root").alias("of"), each_salt("bits").alias("salt"))
        open_ = keep(placed.join(undone, ["bucket", "salt"]), "near-open")
        if open_.isEmpty():
            break
        if turn < how.pivots:
            pairs = keep(open_.where(F.col("root") != F.col("of")).select(F.col("id").alias("a"), "b").distinct(), "near-pairs")
            tried = pairs if turn == 0 else tried.unionByName(pairs)
        else:
            either = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = keep(remaining(open_.select("bucket", "id", "root"), texts, nodes, how, keep).distinct().join(either, ["a", "b"], "left_anti"), "near-pairs")
            if pairs.isEmpty():
                break
        found = keep(compare(pairs, texts, how), "near-found")
        links = found if links is None else links.unionByName(found)
        roots = keep(components(links, keep), "near-roots")
        if turn < how.pivots:  # pivots aren't used again, in whichever bucket
            used = pairs.select(F.col("b").alias("id")).distinct().withColumn("spent", F.lit(True))
            state = roots.select("id", F.col("root").alias("now")).join(used, "id", "full")
            mass = F.when(F.col("spent"), -1).otherwise(F.col("mass"))
            placed = open_.join(state, "id", "left").select("bucket", "salt", "id", mass.alias("mass"), F.coalesce("now", "id").alias("root"))
    if roots is None:
        return nodes.select("node", "id", "rep", F.col("id").alias("root"))
    return nodes.join(roots, "id", "left").select("node", "id", "rep", F.coalesce("root", "id").alias("root"))


def classes(docs: DataFrame, how: Near = Near(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, class_id, row`` of every row: the least id of the class of its text, and
    a hash of all its columns."""
    keep = Scratch(docs.sparkSession)
    with arrow_batches(docs.sparkSession, how.batch):
        signed = keep(sign(docs, how, text, key), "near-signed")
        nodes = keep(_linked(docs, signed, how, text, key, keep), "near-linked")
    least = nodes.groupBy("root").agg(F.min("rep").alias("class_id"))
    nodes = keep(_of_key(nodes, least, "root", "id").select("node", "class_id"), "near-classes")
    placed = _of_key(signed.select("doc_id", "node", "row"), nodes, "node", "row", "left")
    out = materialize(placed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), "row"), "near-result")
    keep.clear()
    return out


def first_of_class(docs: DataFrame, how: Near = Near(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with one row of each class, the least by id and then by a hash of its
    columns. Rows without an id stay; rows without words are classes by their id; of rows
    equal in all columns one stays; texts of one id are told apart, so none is lost."""
    keep = Scratch(docs.sparkSession)
    with arrow_batches(docs.sparkSession, how.batch):
        signed = keep(sign(docs, how, text, key), "near-signed")
        nodes = keep(_linked(docs, signed, how, text, key, keep), "near-linked").select("node", "root")
    rows = keep(signed.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "node", "row").agg(F.count("*").alias("n")), "near-rows")
    of_text = keep(_of_key(rows.where(F.col("node").isNotNull()), nodes, "node", "row").select("doc_id", "row", F.col("root").alias("of")), "near-placed")
    alone = rows.where(F.col("node").isNull()).select("doc_id", "row", F.col("doc_id").alias("of"))
    least = lambda df: df.groupBy("of").agg(F.min(F.struct("doc_id", "row")).alias("m"))
    gone = [_of_key(df, least(df), "of", "row").where(F.struct("doc_id", "row") != F.col("m")).select("doc_id", "row") for df in (of_text, alone)]
    gone = materialize(gone[0].unionByName(gone[1]).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")), "near-gone")
    again = materialize(rows.where("n > 1").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")), "near-again")
    keep.clear()
    marked = docs.withColumns({"__id": F.col(f"`{key}`").cast("long"), "__row": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])})
    marked = marked.join(gone, ["__id", "__row"], "left_anti")
    if not again.isEmpty():
        marked = marked.join(again, ["__id", "__row"], "left_anti").unionByName(marked.join(again, ["__id", "__row"], "left_semi").dropDuplicates(["__id", "__row"]))
    return marked.drop("__id", "__row")
