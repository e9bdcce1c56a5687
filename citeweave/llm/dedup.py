"""Near duplicates: MinHash signatures, banding, verification, connected components.

1. Every row becomes its set of five-word shingles, as 64-bit hashes, and the minima
   of ``BANDS * ROWS`` universal hash functions over that set. Rows with the same words
   form a class, which has a number of its own, the node, and its smallest id.
2. Each band of minima is a bucket key. In every bucket the smallest node is paired
   with each other member: no more pairs than members. Pairs whose signatures agree
   too little for the threshold go; the rest is confirmed on the full sets.
3. Confirmed links give components, by alternating large-star and small-star.
4. A pair inside a component needs no further test, but members of one bucket that
   are still in different components do. Such buckets are gathered with signatures,
   large ones in pairs of blocks, and compared where they lie. Of the pairs that could
   be links only a spanning forest leaves the task, so its size follows the members.
5. The forests join classes into neighbourhoods. A neighbourhood is gathered with
   texts, again in pairs of blocks, and all its pairs of different components are
   confirmed or refuted on full sets, but for those whose components a link found
   just before has joined already. The links found join the components.

So every candidate pair that could change a component is confirmed or refuted, and no
step hands on more rows than members times blocks. A group is cut into up to
``SPREAD`` blocks for the sake of many tasks, and into more only where a block would
be too large for one: see ``_blocks``.

The chance that a pair at the threshold shares no bucket is (1 - 0.75**5)**44, about
seven in a million, and falls steeply above it. Signatures are compared by one byte a
minimum, with a margin of five standard deviations below the threshold.

Joins that move texts, signatures or buckets are sort-merge joins at every size, which
adaptive execution can split where a key is hot. Rows without words meet nothing and
take no part in any of them. All tables written on the way are deleted in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ._shared import discard, keep_alone, materialize, text_slices

WORDS, PERCENT = 5, 75
BANDS, ROWS = 44, 5
#: Minima of a signature; the first BANDS * ROWS of them make the bands.
HASHES = 256
#: Members of a bucket that make a block, as long as there are few blocks; and those of a neighbourhood, which bring their texts.
BLOCK, TEXT_BLOCK = 2048, 256
#: Blocks up to which a group is cut for the sake of many tasks.
SPREAD = 64
#: The most that a block may hold: members with signatures, and bytes of texts.
MOST_MEMBERS, MOST_BYTES = 16_384, 32_000_000
#: Agreeing minima that a pair needs to be confirmed on full sets: 0.75 less five standard deviations.
LEAST_AGREEING = int(HASHES * (PERCENT / 100 - 5 * (PERCENT / 100 * (1 - PERCENT / 100) / HASHES) ** 0.5))
#: Distinct words whose hashes a worker keeps.
WORD_CACHE = 400_000
_COLUMNS = 512

_draw = np.random.default_rng(7_919)
_odd = lambda n: _draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _odd(WORDS)
MULTIPLY, ADD = _odd(HASHES)[:, None], _odd(HASHES)[:, None]
BAND_MULTIPLY = _odd(ROWS)
BAND_ADD = _odd(BANDS)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        h = xxhash.xxh3_64_digest(word)
        if len(self) < WORD_CACHE:
            self[word] = h
        return h


_words = _WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at space and U+0009 to U+000D: what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes]) -> np.ndarray:
    """The distinct shingles as ascending 64-bit hashes; fewer than five words are one shingle, none are none."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(_words.__getitem__, words)), np.uint64)
    n = len(h) - WORDS + 1
    if n < 1:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    total = h[:n] * PLACE[0]
    for i in range(1, WORDS):
        total += h[i : i + n] * PLACE[i]
    return np.unique(total)


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function over the set, upper 32 bits; the set must not be empty."""
    x = found >> np.uint64(32)
    out = np.full(HASHES, np.iinfo(np.uint64).max)
    for lo in range(0, len(x), _COLUMNS):
        part = MULTIPLY * x[None, lo : lo + _COLUMNS]
        part += ADD
        np.minimum(out, part.min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band; the band's number is part of it."""
    mixed = (least[: BANDS * ROWS].reshape(BANDS, ROWS) * BAND_MULTIPLY).sum(1, dtype=np.uint64) + BAND_ADD
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the Jaccard similarity of two sets at least the threshold? Exact on the sets' hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both) and both > 0


def class_key(words: list[bytes]) -> bytes:
    """The same for rows of the same words."""
    return xxhash.xxh3_128_digest(b" ".join(words))


@F.arrow_udf(BinaryType())
def _class_of(texts: pa.Array) -> pa.Array:
    return pa.array([class_key(words_of(t.as_py())) for t in texts], pa.binary())


_SIGNED = "doc_id long, class binary, n_shingles long, signature binary, bands array<long>"


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_alone("near duplicates", _words.clear)
    for part, texts in text_slices(batches, most=2_000_000):
        if len(_words) >= WORD_CACHE:
            _words.clear()
        keys, sizes, signatures, bands = [], [], [], []
        for text in texts:
            words = words_of(text)
            found = shingles(words)
            keys.append(class_key(words))
            sizes.append(len(found))
            if len(found):
                least = minima(found)
                signatures.append(least.astype(np.uint8).tobytes())
                bands.append(band_keys(least))
            else:
                signatures.append(None)
                bands.append(None)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "class", "n_shingles", "signature", "bands"],
        )


def _agree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            matrix = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b")]
            keep = (matrix[0] == matrix[1]).sum(1) >= LEAST_AGREEING
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))


def _confirm_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_alone("near duplicates", _words.clear)
    recent: dict[int, np.ndarray] = {}

    def of(node: int, text: str | None) -> np.ndarray:
        if node not in recent:
            if len(recent) >= 256:
                recent.clear()
            recent[node] = shingles(words_of(text))
        return recent[node]

    for batch in batches:
        if len(_words) >= WORD_CACHE:
            _words.clear()
        ids = [batch.column(c).to_pylist() for c in ("a", "b")]
        texts = [batch.column(c) for c in ("text_a", "text_b")]
        keep = [similar(of(a, texts[0][i].as_py()), of(b, texts[1][i].as_py())) for i, (a, b) in enumerate(zip(*ids, strict=True))]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


class _Sets(dict):
    """Disjoint sets, for what one task has seen."""

    def find(self, x: int) -> int:
        while (up := self.setdefault(x, x)) != x:
            self[x] = x = self.setdefault(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        """Were they apart?"""
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)
        return x != y


class _Gathered:
    """Rows of one group, or of two blocks of it; pairs of different components that could be links.

    Without texts a spanning forest of these pairs is the result, with texts one of
    those among them that are links.
    """

    COLUMNS = ("node", "component", "n_shingles", "signature", "own", "bucket", "lo", "hi")

    def __init__(self, texts: bool):
        self.texts = texts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_alone("near duplicates", _words.clear)
        held, key = [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*self.COLUMNS, *["text"] * self.texts)]
            out: list[tuple[int, int]] = []
            for row in zip(*columns, strict=True):
                if row[5:8] != key:
                    out += self.pairs(held, key)
                    held, key = [], row[5:8]
                held.append(row)
            if out:
                yield self.batch(out)
        if last := self.pairs(held, key):
            yield self.batch(last)

    @staticmethod
    def batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*pairs, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def pairs(self, rows: list[tuple], key: tuple | None) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        node, component, size, own = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2, 4))
        if (component == component[0]).all():
            return []
        if len(_words) >= WORD_CACHE:
            _words.clear()
        signs = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, HASHES)
        out, joined, known = [], _Sets(), {}

        def shingled(i: int) -> np.ndarray:
            if i not in known:
                known[i] = shingles(words_of(rows[i][8]))
            return known[i]

        step = max(1, 4_000_000 // (len(rows) * HASHES))
        for lo in range(0, len(rows), step):
            part = slice(lo, lo + step)
            wanted = (node[part, None] < node[None, :]) & (component[part, None] != component[None, :])
            if key[1] != key[2]:
                wanted &= own[part, None] != own[None, :]
            wanted &= 100 * np.minimum(size[part, None], size[None, :]) >= PERCENT * np.maximum(size[part, None], size[None, :])
            x, y = np.nonzero(wanted)
            for at in range(0, len(x), 16_384):
                i, j = x[at : at + 16_384] + lo, y[at : at + 16_384]
                good = (signs[i] == signs[j]).sum(1) >= LEAST_AGREEING
                for m, n in zip(i[good].tolist(), j[good].tolist(), strict=True):
                    c, d = int(component[m]), int(component[n])
                    if not self.texts:
                        # a forest over documents: what it joins is looked at again, pair by pair
                        if joined.join(int(node[m]), int(node[n])):
                            out.append((int(node[m]), int(node[n])))
                    elif joined.find(c) != joined.find(d) and similar(shingled(m), shingled(n)):
                        joined.join(c, d)
                        out.append((int(node[m]), int(node[n])))
        return out


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b) of class representatives those that sizes and signatures allow to be links."""
    own = classes.select("node", "n_shingles", "signature")
    side = lambda c: own.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"sig_{c}")).hint("merge")
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    met = met.filter(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")).select("a", "b", "sig_a", "sig_b")
    return met.mapInArrow(_agree_batches, "a long, b long")


def _blocks(n: Column, small: int, least: Column) -> Column:
    """Blocks of a group of n members: ``small`` ones while these are at most SPREAD, and at least ``least``."""
    return F.greatest(F.least(F.ceil(n / small), F.lit(SPREAD)), least).cast("int")


def _compared(rows: DataFrame, sizes: DataFrame, texts: bool) -> DataFrame:
    """Pairs (a, b) found within each ``bucket``; ``sizes`` has bucket and blocks."""
    rows = rows.join(sizes.select("bucket", "blocks").hint("merge"), "bucket")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*_Gathered.COLUMNS, *["text"] * texts).repartition(n, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return dealt.mapInArrow(_Gathered(texts), "a long, b long")


def _texts(nodes: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """node and text of the class of every node (column node); one row of the class's words and smallest id, if several have them."""
    wanted = classes.select("node", "class", "doc_id").join(nodes.select("node").distinct().hint("merge"), "node").select("doc_id", "node", "class")
    met = documents.select("doc_id", "text").join(wanted.hint("merge"), "doc_id").filter(_class_of("text") == F.col("class"))
    return met.groupBy("doc_id", "node").agg(F.first("text").alias("text")).select("node", "text")


def _bridges(met: DataFrame, first: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """Links between classes of different components that met in a bucket, enough of them to join what they join."""
    signs = classes.select("node", "n_shingles", "signature")
    placed = met.select("bucket", "node").join(first, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.count("*").alias("n")).filter("first <> last")
    mixed = materialize(mixed.select("bucket", _blocks(F.col("n"), BLOCK, F.ceil(F.col("n") / MOST_MEMBERS)).alias("blocks")), "mixed")
    open_rows = placed.join(mixed.select("bucket").hint("merge"), "bucket").join(signs.hint("merge"), "node")
    forest = materialize(_compared(open_rows, mixed, False).distinct(), "forest")
    joined = components(forest)
    near = joined.select("node", F.col("component").alias("bucket"))
    texts = materialize(_texts(near, classes, documents), "texts")
    rows = texts.join(near.hint("merge"), "node").join(signs.hint("merge"), "node").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = texts.select("node", F.octet_length("text").alias("bytes")).join(near.hint("merge"), "node").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sizes = sizes.select("bucket", _blocks(F.col("n"), TEXT_BLOCK, F.greatest(F.ceil(F.col("n") / MOST_MEMBERS), F.ceil(F.col("bytes") / MOST_BYTES))).alias("blocks"))
    # written, because adaptive execution splits a hot side only of a join that reads both its sides from shuffles
    sizes = materialize(sizes, "sizes")
    out = materialize(_compared(rows, sizes, True), "bridges")
    for used in (mixed, forest, joined, texts, sizes):
        discard(used)
    return out


def confirmed(likely: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are links on their full sets. ``likely`` is read several times."""
    held = materialize(_texts(likely.select(F.col("a").alias("node")).union(likely.select("b")), classes, documents), "texts")
    text = lambda c: held.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")).hint("merge")
    both = likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
    links = materialize(both.mapInArrow(_confirm_batches, "a long, b long").distinct(), "links")
    discard(held)
    return links


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of the edges (columns a, b); a written table.

    Alternating large-star and small-star; each round is written to the shared folder.
    A node's smallest neighbour is found by a grouped minimum, which combines before
    the shuffle, and joined back, where a hub's edges can be split.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.col("u").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum(F.col("v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen or not state[0]:
            break
        seen = state
        # large-star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and its smaller neighbours go to the smallest of these
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "edges")
        discard(now)
        now = after
    roots = now.select(F.col("v").alias("node")).distinct()
    out = materialize(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component"))), "components")
    discard(now)
    return out


def _judged(documents: DataFrame) -> DataFrame:
    """doc_id, class, n_shingles, component_id and ``stays`` of every row; a written table.

    Of a component the class of the smallest id stays (of several classes with that id
    the first by key), in its rows of that id.
    """
    signed = materialize(documents.select("doc_id", "text").mapInArrow(_sign_batches, _SIGNED), "signed")
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    # one row a class, combined before the shuffle; the smallest id brings its signature along
    least = signed.filter(usable).groupBy("class").agg(F.min(F.struct("doc_id", "n_shingles", "signature", "bands")).alias("r"))
    # ids may repeat with other words, so a class is numbered when it is written
    classes = materialize(least.select(F.monotonically_increasing_id().alias("node"), "class", "r.doc_id", "r.n_shingles", "r.signature", "r.bands"), "classes")
    rows = classes.select("node", F.explode("bands").alias("bucket"))
    crowded = rows.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("bucket", "leader")
    met = materialize(rows.join(crowded.hint("merge"), "bucket"), "buckets")
    stars = materialize(met.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    likely = materialize(_agreeing(stars, classes), "likely")
    links = confirmed(likely, classes, documents)
    first = components(links)
    more = _bridges(met, first, classes, documents)
    label = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"at_{c}"))
    second = components(more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("at_a", "a").alias("a"), F.coalesce("at_b", "b").alias("b")))
    joined = second.select(F.col("node").alias("component"), F.col("component").alias("joined"))
    placed = classes.select("class", "node", "doc_id").join(first, "node", "left").select("class", "doc_id", F.coalesce("component", "node").alias("component"))
    placed = placed.join(joined, "component", "left").select("class", "doc_id", F.coalesce("joined", "component").alias("component"))
    heads = placed.groupBy("component").agg(F.min(F.struct("doc_id", "class")).alias("head"))
    final = placed.join(heads, "component").select("class", F.col("head.doc_id").alias("component_id"), (F.col("class") == F.col("head.class")).alias("leads"))
    linked = signed.filter(usable).select("doc_id", "class", "n_shingles").join(final, "class")
    linked = linked.select("doc_id", "class", "n_shingles", "component_id", (F.col("leads") & (F.col("doc_id") == F.col("component_id"))).alias("stays"))
    # rows without words or without an id are linked with nothing
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).cast("long")
    apart = signed.filter(~usable).select("doc_id", "class", "n_shingles", alone.alias("component_id"), F.lit(True).alias("stays"))
    out = materialize(linked.union(apart), "near-duplicates")
    for used in (signed, classes, met, stars, likely, links, first, more, second):
        discard(used)
    return out


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    A row is its words: rows that repeat an id are judged each for itself, and an id's
    rows of other words may lie in other components. A component's id is the smallest id
    in it. Null and empty texts have no shingles and are linked with nothing; ``kept``.
    Rows with a null id are linked with nothing either; their component is null and they
    are kept. Very long texts are sets like others. An empty table gives no rows; other
    columns are not read, whatever their names. Jobs run when this is called; the result
    reads the one narrow table that they leave.
    """
    out = _judged(documents).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_duplicates(documents: DataFrame) -> DataFrame:
    """The same columns; of every component one row stays, of the smallest id.

    Rows without words and rows without an id all stay. Where rows repeat an id, those
    whose words are another component's are judged there; of rows of the same id and
    words one stays, and which is not defined.
    """
    judged = _judged(documents)
    worded = judged.filter("doc_id is not null and n_shingles > 0")
    ids = judged.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("stays").alias("any"))
    # ids of one row, or of rows that all go, need no look at the words again
    simple = documents.join(ids.filter("n > 1 or not any").select("doc_id"), "doc_id", "left_anti").select(*documents.columns)
    several = documents.join(ids.filter("n > 1 and any").select("doc_id"), "doc_id", "left_semi").select(*documents.columns)
    keyed = several.withColumn("__class", _class_of("text"))
    empty = keyed.filter(F.col("__class") == F.lit(class_key([])))
    stay = worded.filter("stays").select("doc_id", F.col("class").alias("__class")).distinct()
    full = keyed.join(stay, ["doc_id", "__class"], "left_semi").dropDuplicates(["doc_id", "__class"])
    return simple.unionByName(empty.select(*documents.columns)).unionByName(full.select(*documents.columns))
