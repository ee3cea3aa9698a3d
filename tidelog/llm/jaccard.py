"""Near-duplicate documents by a set-similarity join with adaptive multi-match prefixes.

A document is the set of its distinct 5-word shingles; two link at a Jaccard similarity
of 0.8 or more. All sets are put into one global order, rare shingles first. A set of n
shingles needs t = ceil(0.8 n) of them in any partner, so the first n - t + l of its
shingles hold at least l shared ones. Each set chooses its own l: a longer prefix costs
more postings, but a partner must then share l of them, so at most 1/l of the postings
can become candidates. A pair is verified if its prefixes share min(l1, l2) shingles.

1. Texts become sets once each; equal sets become one class with one key.
2. Shingles are dealt by their hash in packed rows, counted, and those that more than
   one class has return to their classes. A shingle of one class alone cannot be
   shared, and comes first in the order: a class with fewer than t others has no
   partner. Shingles that a sample shows in a large share of all documents skip this
   exchange: they come last in the order, and no task gathers their postings.
3. Lists of postings are compared once if several shingles have the same list. In rounds,
   until one finds little, each class is compared with one pivot of each list, the centre
   of its copies; links merge classes, so a group of near copies is one component after
   about as many comparisons as it has members.
4. At last, pairs of unmerged classes that share prefix shingles are compared, so no link
   between two components is lost. The larger two sets are, the more they must share, so
   a posting's place in its prefix bounds the size of the partners it can lead to; one
   that only smaller sets can be found by is not looked up by others of its size. What is
   left of a long list is dealt out in blocks, so no task compares more than a block of
   classes with another, and a pair is a row only if it passes all filters.

Shingles are compared by 48 bits of a hash and their part's number, classes by 64 bits
and their size. Among N classes two different sets would have one key and size by chance
with a probability below N^2 / 2^65.

Defined results: words are runs of characters other than space and U+0009 to U+000D,
with A-Z in lower case. With fewer than five words the whole sequence is one shingle;
null and empty texts have none and link with nothing, each its own component. Equal
texts link. A null id is larger than any other. Repeated rows are told apart by their
place in the scan. An empty table gives an empty table. Other columns are not read, and
`one_of_each` returns them unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bytesops, packed_rows
from tidelog.llm.common import arrow_schema, documents, frugal, only, relieve, row_key, setting, shuffle_parts, small_batches, spans_of, staged, steady, text_buffer
from tidelog.llm.exact_dedup import BROADCAST_ROWS, without_rows
from tidelog.llm.graph import components

WIDTH = 5
PERCENT = 80
#: Shingles per part of the exchange, on average.
PART_SHINGLES = 2_000_000
#: Documents sampled for very common shingles, and the count there that makes one common.
SAMPLE_DOCS, SAMPLE_RATE, COMMON_COUNT = 10_000, 1e-5, 10
LONGEST_MATCH = 8
#: Cost of verifying a pair against that of one posting.
VERIFY_COST = 20.0
#: Rounds at most in which each class is compared with one pivot of each list only.
PIVOTS = 4
#: There is another round after one in which this share of pairs were links.
WORTH_A_ROUND = 0.05
#: Bits of a class's parity.
PARITY = 2048
#: Classes of a posting list that one block has.
BLOCK_CLASSES = 2000


def needed(n: np.ndarray | int):
    """Shingles that a set of n must share with any partner."""
    return (PERCENT * n + 99) // 100


def needed_of(n: int, m: int) -> int:
    """Shingles that sets of n and m must share."""
    return (PERCENT * (n + m) + 99 + PERCENT) // (100 + PERCENT)


def mask_of(bits: int) -> np.uint64:
    """Hash bits in use: the part's number and 48 more."""
    return np.uint64((((1 << bits) - 1) << (64 - bits)) | ((1 << 48) - 1))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, mask: np.uint64) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle codes) of every row, in order."""
    for a, b in spans_of(offsets, bytesops.BLOCK):
        words = bytesops.words_of(data, offsets[a : b + 1])
        edges = np.searchsorted(words.doc, np.arange(b - a + 1))
        runs = bytesops.shingle_codes(words.code, WIDTH)
        for i in range(b - a):
            first, last = int(edges[i]), int(edges[i + 1])
            if last - first >= WIDTH:
                yield a + i, np.unique(runs[first : last - WIDTH + 1] & mask)
            elif last > first:
                n = last - first
                yield a + i, bytesops.mix(bytesops.shingle_codes(words.code[first:last], n) ^ np.uint64(n)) & mask
            else:
                yield a + i, np.zeros(0, np.uint64)


def key_of(codes: np.ndarray) -> int:
    """A class's key: of the set's content alone."""
    return xxhash.xxh3_64_intdigest(codes.tobytes()) - (1 << 63)


def listed(common: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(codes), bool)
    return common[np.minimum(np.searchsorted(common, codes), len(common) - 1)] == codes


def common_shingles(docs: DataFrame, n_docs: int, bits: int) -> np.ndarray:
    """Shingles found in at least COMMON_COUNT of about SAMPLE_DOCS documents, or of a
    share SAMPLE_RATE if that is more, so that a shingle of some million documents is
    among them however many there are. They steer cost, not results."""
    share = int(min(1.0, max(SAMPLE_DOCS / max(n_docs, 1), SAMPLE_RATE)) * (1 << 30))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("common")), F.lit(1 << 30)) < share).select("text")
    mask, groups = mask_of(bits), 64
    out, found = arrow_schema("g int, codes binary"), arrow_schema("code long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in shingle_sets(*text_buffer(batch.column(0)), mask)]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            group = flat >> np.uint64(58)
            rows = [flat[group == g].tobytes() for g in range(groups)]
            yield pa.RecordBatch.from_arrays([pa.array(range(groups), pa.int32()), pa.array(rows, pa.binary())], schema=out)

    def count(table: pa.Table) -> pa.Table:
        code, n = np.unique(np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint64), return_counts=True)
        return pa.Table.from_arrays([pa.array(code[n >= COMMON_COUNT].view(np.int64))], schema=found)

    rows = chosen.mapInArrow(frugal(run), "g int, codes binary").groupBy("g").applyInArrow(frugal(count), "code long").toArrow()
    return np.sort(rows["code"].to_numpy().view(np.uint64))


def described(docs: DataFrame, bits: int, common: np.ndarray) -> DataFrame:
    """(row, doc_id, n, key, common) of each document; key is null for an empty set."""
    schema = "row long, doc_id long, n long, key long, common binary"
    out, mask = arrow_schema(schema), mask_of(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in shingle_sets(*text_buffer(batch.column(2)), mask)]
            columns = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([key_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([s[listed(common, s)].tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=out)

    return docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), schema)


#: What packed rows say of a class and of its shingles.
OWNERS, ITEMS = {"keys": np.int64, "sizes": np.uint32}, {"low": np.uint32, "mid": np.uint16}


def dealt(docs: DataFrame, bits: int, common: np.ndarray) -> DataFrame:
    """Packed rows (part, keys, sizes, counts, low, mid): the shingles of some classes
    that fall into one part of the hash range, class by class."""
    rest = packed_rows.fine_bits(bits)
    schema = packed_rows.schema_of(OWNERS, ITEMS, rest)
    out, mask = arrow_schema(schema), mask_of(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {}
            for _, s in shingle_sets(*text_buffer(batch.column(0)), mask):
                if len(s):
                    sets.setdefault(key_of(s), s)
            if not sets:
                continue
            keys = np.array(list(sets), np.int64)
            sizes = np.array([len(s) for s in sets.values()], np.uint32)
            rare = [s[~listed(common, s)] for s in sets.values()]
            flat = np.concatenate(rare)
            owner = np.repeat(np.arange(len(rare)), [len(s) for s in rare])
            part, fine = packed_rows.coarse(flat, bits, rest)
            rows = packed_rows.rows_of(part, owner, [keys, sizes], [flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint16), *fine])
            yield packed_rows.batch_of(rows, out)

    return packed_rows.finer(docs.select("text").mapInArrow(frugal(run), schema), bits, OWNERS, ITEMS)


def joined_buffers(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


RETURNED = "bucket int, keys binary, sizes binary, counts binary, codes binary, df binary"


def returned(parts: DataFrame, bits: int) -> DataFrame:
    """Counts the classes of each shingle, and returns those shingles that several
    classes have, packed by bucket of the class."""
    out = arrow_schema(RETURNED)

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        keys, counts, sizes = joined_buffers(table, "keys", np.int64), joined_buffers(table, "counts", np.uint32), joined_buffers(table, "sizes", np.uint32)
        code = joined_buffers(table, "low", np.uint32).astype(np.uint64) | joined_buffers(table, "mid", np.uint16).astype(np.uint64) << np.uint64(32)
        del table
        distinct, first, number = np.unique(keys, return_index=True, return_inverse=True)
        size = sizes[first]
        owner = np.repeat(number.astype(np.uint32), counts)
        order = np.lexsort((owner, code))
        code, owner = code[order], owner[order]
        fresh = np.ones(len(code), bool)  # equal sets from different batches come up twice
        fresh[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        code, owner = code[fresh], owner[fresh]
        edges = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, int)
        runs = np.diff(np.append(edges, len(code)))
        df = np.repeat(runs, runs).astype(np.uint32)
        shared = df > 1
        code, owner, df = code[shared] | np.uint64(part << (64 - bits)), owner[shared], df[shared]
        bucket = (distinct[owner] & ((1 << bits) - 1)).astype(np.int64)
        order = np.lexsort((owner, bucket))
        code, owner, df, bucket = code[order], owner[order], df[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bits))
        rows = []
        for a, b in zip(edges[:-1], edges[1:]):
            own, n = np.unique(owner[a:b], return_counts=True)
            rows.append((int(bucket[a]), distinct[own].tobytes(), size[own].astype(np.uint32).tobytes(), n.astype(np.uint32).tobytes(), code[a:b].tobytes(), df[a:b].tobytes()))
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(out)], schema=out)

    return parts.groupBy("part").applyInArrow(frugal(run), RETURNED)


def with_common(described_: DataFrame, bits: int) -> DataFrame:
    """The common shingles of each class, as rows like those of `returned`; their
    count is the largest there is, which puts them last in the order."""
    out = arrow_schema(RETURNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.uint32(0xFFFFFFFF)
        for batch in batches:
            rows = []
            for key, n, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                count = len(codes) // 8
                rows.append((key & ((1 << bits) - 1), np.array([key]).tobytes(), np.array([n], np.uint32).tobytes(), np.array([count], np.uint32).tobytes(), codes, np.full(count, last).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(out)], schema=out)

    classes = described_.where("key is not null and length(common) > 0").groupBy("key", "n").agg(F.first("common").alias("common"))
    return classes.select("key", "n", "common").mapInArrow(frugal(run), RETURNED)


def choose_match(df: np.ndarray, base: int, most: int) -> int:
    """The l up to `most` whose prefix, base + l - 1 of the shared shingles, costs
    least: its postings, and the candidates that can share l of them. base may be below
    one, if shingles that no other class has fill the prefix."""
    lengths = np.arange(1, max(1, min(LONGEST_MATCH, most)) + 1)
    sums = np.append(0.0, np.cumsum(np.minimum(df, 1 << 20).astype(np.float64)))
    hits = sums[np.clip(base + lengths - 1, 0, len(df))]
    return int(lengths[np.argmin(hits + VERIFY_COST * hits / lengths)])


def parity_of(codes: np.ndarray) -> np.ndarray:
    """Which residues an odd number of codes have, as 64-bit words."""
    odd = np.bincount((bytesops.mix(codes) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def survivors(rows: DataFrame) -> DataFrame:
    """(key, n, match, prefix, centre, parity, codes) of the classes that may have a
    partner: codes are those shared with others, in the global order; the first `prefix`
    are the prefix. centre is the mean logarithm of how many classes have a shingle of
    the set."""
    schema = "key long, n long, match int, prefix int, centre double, parity array<long>, codes array<long>"
    out = arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        keys, counts, sizes = joined_buffers(table, "keys", np.int64), joined_buffers(table, "counts", np.uint32), joined_buffers(table, "sizes", np.uint32)
        code, df = joined_buffers(table, "codes", np.uint64), joined_buffers(table, "df", np.uint32)
        distinct, first, number = np.unique(keys, return_index=True, return_inverse=True)
        size, owner = sizes[first].astype(np.int64), np.repeat(number, counts)
        enough = np.bincount(owner, minlength=len(distinct)) >= needed(size)
        keep = enough[owner] if len(owner) else np.zeros(0, bool)
        code, df, owner = code[keep], df[keep], owner[keep]
        order = np.lexsort((code, df, owner))
        code, df, owner = code[order], df[order], owner[order]
        rows = []
        edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-2))
        for a, b in zip(edges[:-1], edges[1:]):
            n = int(size[owner[a]])
            base = (b - a) - needed(n) + 1
            # Costs are those of partners of the same size, with which more must be shared.
            match = choose_match(df[a:b], (b - a) - needed_of(n, n) + 1, (b - a) - base + 1)
            centre = float(np.log2(df[a:b].astype(np.float64)).sum() / n)
            rows.append((int(distinct[owner[a]]), n, match, base + match - 1, centre, parity_of(code[a:b]), code[a:b].view(np.int64)))
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(out)], schema=out)

    return rows.groupBy("bucket").applyInArrow(frugal(run), schema)


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Shared shingles suffice for the
    intersection; the sizes of the whole sets give the union."""
    side = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("codes").alias(f"codes_{x}"))
    both = F.size(F.array_intersect("codes_a", "codes_b"))
    firsts = pairs.select("a").distinct()
    if pairs.count() <= BROADCAST_ROWS:
        pairs, firsts = F.broadcast(pairs), F.broadcast(firsts)
    return (
        pairs.join(side("b"), "b").join(side("a").join(firsts, "a", "left_semi"), "a")
        .where(100 * both >= PERCENT * (F.col("n_a") + F.col("n_b") - both))
        .select("a", "b")
    )


def fits(n_a: str, n_b: str) -> F.Column:
    """Whether two sizes allow the similarity at all."""
    return (100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b))


def postings(classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(code, key, n, match, centre, most, root, alone) of every class's prefix. most:
    the largest partner in whose prefix with this class the shingle is: with p shingles
    before it, that needs n - p + match - 1 to be at least what both must share. alone:
    the class is not linked to any yet."""
    own = F.col("n") - F.size("codes")
    flat = classes.select("key", "n", "match", "centre", own.alias("own"), F.posexplode(F.slice("codes", F.lit(1), F.col("prefix"))).alias("pos", "code"))
    rest = F.col("n") - F.col("own") - F.col("pos") + F.col("match") - 1
    flat = flat.withColumn("most", F.floor((100 + PERCENT) * rest / PERCENT).cast("long") - F.col("n")).drop("own", "pos")
    if roots is None:
        return flat.withColumns({"root": F.col("key"), "alone": F.lit(True)})
    joined = flat.join(roots, flat.key == roots.node, "left")
    return joined.select("code", "key", "n", "match", "centre", "most", F.coalesce("root", "key").alias("root"), F.col("root").isNull().alias("alone"))


def open_lists(all_: DataFrame, turn: int) -> DataFrame:
    """(code, codes, size, weight, pivot) of the posting lists that hold unmerged classes.
    Lists with the same classes, as the shingles of one passage have, come up once, under
    the least of their codes, with their number as weight.

    The pivot is the class whose shingles most others have: all of a text's shingles
    recur in its copies, while a copy has some of its own, so that is the centre of the
    group. Later turns take the centre of the classes that are still alone.
    """
    member = F.struct(*([F.col("alone")] if turn else []), F.col("centre"), F.col("key"), F.col("n"), F.col("match"), F.col("root"))
    lists = all_.groupBy("code").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("key")).alias("h1"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("h2"), F.max(member).alias("pivot"),
    ).where("least < most")
    same = lists.groupBy("h1", "h2", "size")
    return same.agg(F.min("code").alias("code"), F.collect_list("code").alias("codes"), F.count("*").alias("weight"), F.first("pivot").alias("pivot"))


def star_pairs(all_: DataFrame, lists: DataFrame) -> DataFrame:
    """(a, b): each class with the pivot of each of its lists, if they share enough."""
    return (
        all_.join(lists.drop("codes"), "code").where((F.col("root") != F.col("pivot.root")) & fits("n", "pivot.n"))
        .groupBy(F.col("pivot.key").alias("a"), F.col("key").alias("b"))
        .agg(F.sum("weight").alias("hits"), F.first(F.least("match", "pivot.match")).alias("least")).where("hits >= least").select("a", "b")
    )


def open_postings(all_: DataFrame) -> DataFrame:
    """(list, key, n, match, most, root, weight) of the classes in posting lists that
    hold unmerged ones. Lists with the same classes count once, under the least of their
    codes, with their number as weight and the largest of a class's reaches."""
    lists = all_.groupBy("code").agg(
        F.min("root").alias("least"), F.max("root").alias("top"), F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("key")).alias("h1"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("h2"), F.count(F.when(F.col("most") >= F.col("n"), 1)).alias("found"),
    ).where("least < top and found > 0")
    same = lists.groupBy("h1", "h2", "size").agg(F.min("code").alias("list"), F.collect_list("code").alias("codes"))
    rows = all_.join(same.select("list", F.explode("codes").alias("code")), "code")
    first = [F.first(c).alias(c) for c in ("n", "match", "root")]
    return rows.groupBy("list", "key").agg(F.max("most").alias("most"), F.count("*").alias("weight"), *first)


def all_pairs(all_: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(a, b) of all unmerged classes that may be similar and share enough of their
    prefixes; None if all that share any are merged.

    Of a pair the larger class a looks up the smaller one b, which is found only by
    postings that reach partners of its own size. In each list one root has the most
    classes; pairs of two of these are merged already, so the others are compared with
    all, and these only with the others. Both sides of a comparison are cut into blocks
    of about BLOCK_CLASSES, and each block of one meets each of the other.

    A class's parity has one bit for each residue of a shingle's hash, set if an odd
    number of its shingles have it. Where two parities differ the sets do, so the number
    of such bits is at most the size of the sets' difference. A pair becomes a row only
    if that lets it be similar, so a group of near misses makes hardly any.
    """
    open_ = staged(open_postings(all_), "open")
    if open_.isEmpty():
        return None
    found = F.col("most") >= F.col("n")
    by_root = open_.groupBy("list", "root").agg(F.count("*").alias("n_root"), F.count(F.when(found, 1)).alias("n_found"))
    lists = by_root.groupBy("list").agg(F.sum("n_root").alias("n_all"), F.sum("n_found").alias("all_found"), F.max(F.struct("n_root", "root", "n_found")).alias("main"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK_CLASSES), F.lit(1)).cast("int")
    other_found = F.col("all_found") - F.col("main.n_found")
    lists = staged(lists.select(
        "list", F.col("main.root").alias("main"), (other_found > 0).alias("main_looks"),
        blocks(F.col("n_all") - F.col("main.n_root")).alias("a0"), blocks(F.col("all_found")).alias("b0"),
        blocks(F.col("main.n_root")).alias("a1"), blocks(other_found).alias("b1"),
    ), "lists")
    words = [F.col("parity")[i].alias(f"p{i}") for i in range(PARITY // 64)]
    whole = classes.select("key", (F.col("n") - F.size("codes")).alias("own"), *words)
    is_main = F.col("root") == F.col("main")
    rows = open_.join(lists, "list").where(~is_main | F.col("main_looks") | found)
    rows = staged(rows.join(whole, "key"), "rows")
    parity = [f"p{i}" for i in range(PARITY // 64)]
    kept = ["list", "key", "n", "match", "most", "root", "weight", "own", *parity]
    dealt_to = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)

    def side(x: str, cells: F.Column, rows_: DataFrame) -> DataFrame:
        flat = rows_.select(*kept, F.explode(cells).alias("cell"))
        return flat.select(*[F.col(c).alias(f"{c}_{x}") for c in kept], F.col("cell").alias(f"cell_{x}"))

    cell = lambda turn, i, j: F.struct(F.lit(turn).alias("turn"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    none = F.array().cast("array<struct<turn:int,i:int,j:int>>")
    looks = F.when(~is_main, F.transform(every(F.col("b0")), lambda j: cell(0, dealt_to(F.col("a0")), j)))
    looks = looks.when(F.col("main_looks"), F.transform(every(F.col("b1")), lambda j: cell(1, dealt_to(F.col("a1")), j))).otherwise(none)
    shown = F.transform(every(F.col("a0")), lambda i: cell(0, i, dealt_to(F.col("b0"))))
    shown_again = F.transform(every(F.col("a1")), lambda i: cell(1, i, dealt_to(F.col("b1"))))
    a = side("a", looks, rows)
    b = side("b", F.concat(shown, F.when(~is_main, shown_again).otherwise(none)), rows.where(found))
    size = F.col("n_a") + F.col("n_b")
    apart = F.col("own_a") + F.col("own_b")
    for p in parity:
        apart += F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b")))
    near = (100 + PERCENT) * (size - apart) >= 2 * PERCENT * size
    larger = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("key_a") < F.col("key_b")))
    reach = (F.col("n_b") <= F.col("most_a")) & (F.col("n_a") <= F.col("most_b")) & fits("n_a", "n_b")
    close = (F.col("list_a") == F.col("list_b")) & (F.col("cell_a") == F.col("cell_b")) & (F.col("root_a") != F.col("root_b")) & larger & reach & near
    pairs = a.join(b, close).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), F.col("weight_a").alias("weight"), F.least("match_a", "match_b").alias("least"))
    # As one method this condition is too long for the JVM to compile; apart from
    # whole-stage code it is generated in short ones.
    with setting(classes.sparkSession, "spark.sql.codegen.wholeStage", "false"):
        hits = staged(pairs, "near").groupBy("a", "b").agg(F.sum("weight").alias("hits"), F.first("least").alias("least"))
        return staged(hits.where("hits >= least").select("a", "b"), "pairs")


def links(classes: DataFrame) -> DataFrame | None:
    """(node, root) of all classes that are linked to another; None without any."""
    found = roots = None
    turn, last = 0, PIVOTS < 1
    while True:
        all_ = staged(postings(classes, roots), "postings")
        if last:
            pairs = all_pairs(all_, classes)
            if pairs is None:
                return roots
        else:
            lists = staged(open_lists(all_, turn), "lists")
            if lists.isEmpty():
                return roots
            pairs = staged(star_pairs(all_, lists), "pairs")
        new = staged(verified(pairs, classes), "verified")
        links_found, looked_at = new.count(), pairs.count()
        if links_found:
            found = new if found is None else found.unionByName(new)
            roots = staged(components(found), "roots")
        if last:
            return roots
        relieve(classes.sparkSession)
        turn += 1
        last = links_found <= WORTH_A_ROUND * looked_at or turn >= PIVOTS


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, row. The row that
    is kept has the smallest doc_id of its component."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = only(steady(docs), "doc_id", "text")
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    wanted = max(shuffle_parts(spark), (size.bytes or 0) // 6 // PART_SHINGLES, 2)
    bits = min(32, int(np.ceil(np.log2(wanted))))
    common = common_shingles(docs, size.n, bits)
    known = staged(described(docs, bits, common), "sets")
    shared = returned(dealt(docs, bits, common), bits).unionByName(with_common(known, bits))
    classes = staged(survivors(shared), "classes")
    roots = links(classes)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    by_class = known.where("key is not null").groupBy("key", "n").agg(first, F.count("*").alias("size"))
    if roots is None:
        grouped = by_class.where("size > 1").select("key", "n", "first")
    else:
        rooted = staged(by_class.join(roots, by_class.key == roots.node, "left").where("size > 1 or root is not null").select("key", "n", "first", F.coalesce("root", "key").alias("root")), "rooted")
        heads = staged(rooted.groupBy("root").agg(F.min("first").alias("head")), "heads")
        grouped = rooted.join(heads, "root").select("key", "n", F.col("head").alias("first"))
    grouped = staged(grouped, "groups")
    # An empty set has no key; its row stands in, so that such rows spread out.
    place = known.select("row", "doc_id", "n", F.coalesce("key", "row").alias("key"))
    alone = F.col("first").isNull()
    return place.join(grouped, ["key", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
        "row",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, with all their columns."""
    docs = steady(docs)
    return without_rows(docs, groups(docs).where("not kept"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).drop("row")


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLE = {
    "op5_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.r = e.a)
SELECT c.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id, c.doc_id = min(r) AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id"""
}
