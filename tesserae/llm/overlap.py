"""Problem 4: same or near-same texts across splits, by winnowing fingerprints.

Texts that are equal but for formatting form a class. Hashes of ``K`` words are winnowed: of every ``WINDOW`` neighbours the one that joins the fewest classes is kept
(ties by hash), the same one in all texts that share the run. The fingerprints of training and evaluation classes are joined; the seeds of a pair are chained
collinearly and the gaps between them aligned. A pair is near if more than ``SHARE`` of the words of the longer text are aligned.

No fingerprint is left out for its frequency and no pair for its group. What makes frequent ones cheap is which of them are asked for: more than ``SHARE`` of a training
text's words must be aligned, so at least one of any ``n - floor(SHARE n)`` of them. The words whose fingerprints are the rarest are taken, and only fingerprints that touch
these are looked up among all those of the evaluation texts. So every pair is met of which more than ``SHARE`` of the longer text's words are aligned in runs of
``K + WINDOW - 1`` words or more, and of the others those that have a run in common that touches the rarest words; short texts are also joined by single words. With ``k = window = 1`` runs of one word
are enough, so that every near pair is met for certain, at a higher cost. Where classes meet, an upper bound of their common words, from ``BITS`` hashed
bits a class, decides before a pair becomes a row. The classes of a fingerprint are dealt to squares of ``SIDE`` x ``SIDE``, so no task holds them all.
No table is broadcast here on an estimate: one row of an exploded list counts as a few bytes of the file for the planner, so tables of many times the input would be sent to the driver.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.skew import lookup
from tesserae.session import cut_by_key, cut_lineage, release

#: Words of a rolling hash; neighbouring hashes of which one is kept. Longer ones are cheaper and ask for longer common runs.
K, WINDOW = 2, 2
#: Words up to which a text is joined by its single words too.
SHORT = 12
#: Classes of a side of a square; bits of a class for the bound of common words.
SIDE, BITS = 2000, 512
#: Words of the classes or pairs that a Python worker takes up at a time, whatever the size of a batch.
HELD_WORDS = 200_000
#: Words of a batch of classes, about; keys that a task remembers to pass on a class once; bytes up to which what batches send isn't parted.
BATCH_WORDS, SEEN, PART_BYTES = 300_000, 200_000, 1 << 25
#: Fingerprints of a bucket of squares, about.
SQUARE_ROWS = 500_000
#: Aligned share of the longer text above which a pair is near: between the 2/3 of the cases and the 3/5 of the others, as a word that formatting has cut in two counts as unlike.
SHARE = 0.6333

_ACCENTED = [chr(c) for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0] != chr(c)]


def words(text: Column) -> Column:
    """Words of letters and digits, without case, accents, marks and invisible characters. Null gives null."""
    plain = F.translate(text, "".join(_ACCENTED), "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED))
    bare = F.regexp_replace(F.lower(plain), r"[\p{M}\p{Cf}]+", "")
    return F.filter(F.split(bare, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def split_name(col: str) -> Column:
    """train, validation or test; null for anything else."""
    name = F.lower(F.regexp_replace(F.col(col), r"(?U)^\s+|\s+$", ""))
    return F.when(name.isin("train", "validation", "test"), name)


def _lookup(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """``lookup`` by sorting both sides, never by a broadcast of ``small``: the planner takes tables of fingerprints and words for hundreds of times smaller than they are."""
    return lookup(big, small.hint("merge"), key)


def _slices(batch, words, most: int | None = None) -> Iterator:
    """``batch`` in slices of about ``most`` (``HELD_WORDS``) of ``words`` (an array, per row), of one row at least."""
    import numpy as np

    part = np.cumsum(words.astype(np.int64)) // (most or HELD_WORDS)
    ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip([0, *ends], ends):
        if b > a:
            yield batch.slice(a, b - a)


def _once(batches: Iterator) -> Iterator:
    """Rows ``(id, split, key, w, of_id, of_key)`` as members, and of the rows of a task with one key the first of training and of evaluation as rows of its class, only the first of them with the words."""
    import pyarrow as pa

    seen: dict = {}
    for b in batches:
        names, none = ["batch", "id", "split", "key", "t", "w"], lambda of, n: pa.nulls(n, of.type)
        n, whole, fresh, train = b.num_rows, [], [], []
        for r, (key, split) in enumerate(zip(b.column(2).to_pylist(), b.column(1).to_pylist())):
            was, t = seen.get(key, 0), int(split == "train")
            if not was & 1 << t:
                seen[key] = was | 1 << t
                fresh.append(r)
                train.append(t)
                whole.append(None if was else r)
        if len(seen) > SEEN:
            seen.clear()
        yield pa.RecordBatch.from_arrays([b.column(4), b.column(0), b.column(1), b.column(2), pa.nulls(n, pa.int32()), none(b.column(3), n)], names)
        at = pa.array(fresh, pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(5).take(at), none(b.column(0), len(at)), none(b.column(1), len(at)), b.column(2).take(at), pa.array(train, pa.int32()), b.column(3).take(pa.array(whole, pa.int32()))], names)


def text_classes(df: DataFrame, id_col: str, text_col: str, split_col: str) -> tuple[DataFrame, DataFrame]:
    """Members ``(id, split, cid)`` and rows of classes ``(batch, key, t, w)``: MD5 of the words, 1 in training and 0 in evaluation, hashed words (null in some rows of a class).

    All rows of a class are in one batch; of many equal rows each task passes on two, so no batch holds a text that stands in many rows as often. What is written is the words of every
    class once, parted by batch; whatever works on batches reads them where they lie. A class is numbered by its batch and the rank of its key in it.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), split_name(split_col).alias("split"), words(F.col(text_col)).alias("w")).where("id is not null and split is not null and size(w) > 0")
    held = df.agg(F.sum(F.length(text_col))).first()[0] or 0
    n = max(1, -(-held // (6 * BATCH_WORDS)))
    rows = rows.select("id", "split", F.md5(F.array_join("w", " ")).alias("key"), F.transform("w", lambda w: F.hash(w)).alias("w"))
    rows = rows.withColumn("of_id", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("of_key", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.mapInArrow(_once, f"batch int, id {kind}, split string, key string, t int, w array<int>")
    rows = cut_by_key(rows, int(spark.conf.get("spark.sql.shuffle.partitions")), "batch")
    release(spark)
    classes = rows.where("t is not null").select("batch", "key", "t", "w")
    members = cut_lineage(_lookup(rows.where("t is null").select("id", "split", "key"), class_heads(classes).select("key", "cid"), "key").select("id", "split", "cid"))
    return members, classes


class _Batch:
    """The classes of a batch in the order of their keys: numbers, words, in training, in evaluation, and all hashed words in a row."""

    def __init__(self, table) -> None:
        import numpy as np

        table = table.combine_chunks()
        held: dict = {}
        for r, (key, t, whole) in enumerate(zip(table.column("key").to_pylist(), table.column("t").to_pylist(), table.column("w").is_valid().to_pylist())):
            one = held.setdefault(key, [None, 0, 0])
            one[2 - t] = 1
            if whole:
                one[0] = r
        self.batch = table.column("batch")[0].as_py()
        self.keys = sorted(held)
        self.list = table.column("w").take([held[k][0] for k in self.keys]).combine_chunks()
        self.list = self.list if not hasattr(self.list, "chunks") else self.list.chunk(0)
        self.t, self.e = (np.array([held[k][c] for k in self.keys], np.int64) for c in (1, 2))
        self.cid = (np.int64(self.batch) << 32) + np.arange(len(self.keys))
        self.n = np.diff(self.list.offsets.to_numpy()).astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.n)])
        self.owner = np.repeat(np.arange(len(self.n)), self.n)
        self.word = self.list.flatten().to_numpy().view(np.uint32).astype(np.uint64)

    def grams(self, k: int):
        """Class, place and hash of every ``k`` words in a row."""
        import numpy as np

        pos = np.arange(len(self.owner)) - self.base[self.owner]
        g = self.word.copy()
        for d in range(1, k):
            g = (g << np.uint64(32) if d == 1 else _mixed(g)) + np.append(self.word[d:], np.zeros(min(d, len(g)), np.uint64))
        ok = pos + k <= self.n[self.owner]
        return self.owner[ok], pos[ok], _mixed(g)[ok].view(np.int64)


def _mixed(x):
    """64-bit numbers one to one in another order."""
    import numpy as np

    x = x.view(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def class_heads(classes: DataFrame) -> DataFrame:
    """``(key, cid, t, e)`` of every class."""

    def run(table):
        import pyarrow as pa

        b = _Batch(table)
        return pa.table([pa.array(b.keys, pa.string()), pa.array(b.cid), pa.array(b.t.astype("int32")), pa.array(b.e.astype("int32"))], ["key", "cid", "t", "e"])

    return classes.groupBy("batch").applyInArrow(run, "key string, cid bigint, t int, e int")


def _by_bucket(keys, buckets: int):
    """The order of distinct sorted ``keys`` by bucket, and where each bucket begins and the last ends."""
    import numpy as np

    bucket = (keys.view(np.uint64) >> np.uint64(8)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


_COUNTS = "bucket int, batch int, g binary, t binary, e binary"


def _counted(batch: int, keys, train, other, buckets: int):
    """Distinct ``keys`` of a batch with their sums of ``train`` and ``other``, a row for each bucket."""
    import numpy as np
    import pyarrow as pa

    u, inv = np.unique(keys, return_inverse=True)
    order, ends = _by_bucket(u, buckets)
    columns = [u[order]] + [np.bincount(inv, v, len(u))[order].astype(np.uint32) for v in (train, other)]
    held = np.flatnonzero(np.diff(ends))
    cut = [pa.array([c[ends[b] : ends[b + 1]].tobytes() for b in held], pa.binary()) for c in columns]
    return pa.table([pa.array(held.astype(np.int32)), pa.array(np.full(len(held), batch, np.int32)), *cut], ["bucket", "batch", "g", "t", "e"])


def _totals(counts: DataFrame) -> DataFrame:
    """``(batch, bucket, t, e, n_rows)``: to each row of ``counts`` the sums of its keys over all batches (0 where one of the two is), in the same order; ``n_rows`` of the fingerprints that these ask for."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        g, t, e = ([np.frombuffer(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("g", np.int64), ("t", np.uint32), ("e", np.uint32)))
        u, inv = np.unique(np.concatenate(g), return_inverse=True)
        ends, sums = np.cumsum([len(x) for x in g])[:-1], [np.bincount(inv, np.concatenate(v), len(u)).astype(np.int64) for v in (t, e)]
        n_rows = np.zeros(len(g), np.int64)
        sums = [np.where(sums[0] * sums[1] > 0, v, 0) for v in sums]  # of keys that join nothing no number is of use
        n_rows[0] = (sums[0] * -(-sums[1] // SIDE) + sums[1] * -(-sums[0] // SIDE)).sum()
        packed = [pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(v[inv].astype(np.uint32), ends)], pa.binary()) for v in sums]
        return pa.table([table.column("batch"), table.column("bucket"), *packed, pa.array(n_rows)], ["batch", "bucket", "t", "e", "n_rows"])

    return counts.groupBy("bucket").applyInArrow(run, "batch int, bucket int, t binary, e binary, n_rows bigint")


def _answers(table, keys, buckets: int):
    """Of distinct sorted ``keys`` the sums that ``_totals`` gave for them."""
    import numpy as np

    order, _ = _by_bucket(keys, buckets)
    table, out = table.sort_by("bucket"), []
    for c in ("t", "e"):
        got = np.empty(len(keys), np.int64)
        got[order] = np.concatenate([np.zeros(0, np.uint32)] + [np.frombuffer(zlib.decompress(x), np.uint32) for x in table.column(c).to_pylist()])
        out.append(got)
    return out


def _n_batches(classes: DataFrame) -> int:
    return (classes.agg(F.max("batch")).first()[0] or 0) + 1


def _grams(classes: DataFrame, k: int) -> DataFrame:
    """``_totals`` of the hashes of ``k`` words: in how many training and evaluation classes each is."""
    buckets = _n_batches(classes)

    def run(table):
        import numpy as np

        b = _Batch(table)
        owner, _, g = b.grams(k)
        u, inv = np.unique(g, return_inverse=True)
        one = np.unique(inv * len(b.n) + owner)
        return _counted(b.batch, u[one // len(b.n)], b.t[one % len(b.n)], b.e[one % len(b.n)], buckets)

    return _totals(classes.groupBy("batch").applyInArrow(run, _COUNTS))


def _winnow(b: _Batch, answers, buckets: int, k: int, window: int, share: float):
    """``(class, fingerprint, place, is training)``: all kept ones of evaluation classes, those of the rarest words of training classes; and short texts by their single words."""
    import numpy as np

    owner, pos, gram = b.grams(k)
    u, inv = np.unique(gram, return_inverse=True)
    n_t, n_e = _answers(answers, u, buckets)
    pairs = (n_t * n_e)[inv]
    shared = pairs > 0
    owner, pos, gram, pairs = owner[shared], pos[shared], gram[shared], pairs[shared]
    n, t, e, reach = b.n, b.t, b.e, k + window - 1
    # a window whose hashes are not all shared is in no common run
    best, whole = np.arange(len(pos)), np.ones(len(pos), bool)
    for d in range(1, window):
        to = np.minimum(np.arange(len(pos)) + d, len(pos) - 1)
        whole &= (owner[to] == owner) & (pos[to] == pos + d)
        less = whole & ((pairs[to] < pairs[best]) | ((pairs[to] == pairs[best]) & (gram[to] < gram[best])))
        best = np.where(less, to, best)
    start = np.flatnonzero(whole)
    best = best[start]
    # words of all classes in a row; of each the greatest number of pairs of a fingerprint that touches it
    at = b.base[owner[start]] + pos[start]
    cost = np.zeros(b.base[-1], np.int64)
    for d in range(reach):
        # the starts of a window are distinct, so each word is met once at a distance
        cost[at + d] = np.maximum(cost[at + d], pairs[best])
    order = np.lexsort((cost, b.owner))
    rank = np.arange(b.base[-1]) - b.base[b.owner]  # the classes keep their places in the order
    asked = np.zeros(b.base[-1], bool)
    asked[order[rank < (n - np.floor(share * n).astype(np.int64))[b.owner]]] = True
    touched = np.zeros(len(start), bool)
    for d in range(reach):
        touched |= asked[at + d]
    out = [(owner[best[ok]], gram[best[ok]], pos[best[ok]], is_train) for is_train, ok in ((True, touched & (t[owner[start]] == 1)), (False, e[owner[start]] == 1))]
    short = (n <= SHORT)[b.owner]
    of, place = b.owner[short], (np.arange(b.base[-1]) - b.base[b.owner])[short]
    word = _mixed(~(b.word[short] << np.uint64(32))).view(np.int64)
    out += [(of[has[of] == 1], word[has[of] == 1], place[has[of] == 1], is_train) for is_train, has in ((True, t), (False, e))]
    c, s, p, z = (np.concatenate(v) for v in zip(*[(*x, np.full(len(x[0]), is_train)) for *x, is_train in out]))
    # each fingerprint of a class once, at its first place
    order = np.lexsort((p, s, c, z))
    c, s, p, z = c[order], s[order], p[order], z[order]
    first = np.append(True, (c[1:] != c[:-1]) | (s[1:] != s[:-1]) | (z[1:] != z[:-1]))[: len(c)]
    return c[first], s[first], p[first], z[first]


def _bits(owner, word, n_classes: int):
    """A hashed bit per word and time of each class, as 64-bit numbers."""
    import numpy as np

    order = np.lexsort((word, owner))
    o, x = owner[order], word[order]
    first = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (x[1:] != x[:-1]))[: len(x)])
    time = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    with np.errstate(over="ignore"):
        mixed = x * np.uint64(0x9E3779B97F4A7C15) + time.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    bits = np.zeros((n_classes, BITS), np.uint8)
    bits[o, (mixed >> np.uint64(40)) % np.uint64(BITS)] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


#: What a batch keeps of its classes and of the fingerprints that others ask for, and what of it goes to a bucket of squares.
_KEPT = {"s": "i8", "c": "u4", "p": "u4", "z": "u1", "n_t": "u4", "n_e": "u4", "cid": "i8", "n": "u4", "bits": "u8"}
_SENT = {"s": "i8", "square": "i8", "c": "u4", "p": "u4", "z": "u1", "cid": "i8", "n": "u4", "bits": "u8"}


def _kept(b: _Batch, kept, n_t, n_e):
    """A row with the fingerprints of a batch that others ask for."""
    import pyarrow as pa

    alive = n_t * n_e > 0
    values = [*(v[alive] for v in (kept[1], kept[0], *kept[2:], n_t, n_e)), b.cid, b.n, _bits(b.owner, b.word, len(b.n))]
    return pa.table([pa.array([zlib.compress(v.astype(kind).tobytes(), 1)], pa.binary()) for v, kind in zip(values, _KEPT.values())], [*_KEPT])


def _deal(part: int, parts: int, buckets: int):
    """The fingerprints of batches for the squares of one part, a row for each bucket of squares with the classes in it."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for row in (row for batch in batches for row in batch.to_pylist()):
            s, c, p, z, n_t, n_e, cid, n, bits = (np.frombuffer(zlib.decompress(row[name]), kind) for name, kind in _KEPT.items())
            bits, z, n_t, n_e = bits.reshape(len(cid), BITS // 64), z == 1, n_t.astype(np.int64), n_e.astype(np.int64)
            sides = [-(-n_t // SIDE), -(-n_e // SIDE)]
            own, other = np.where(z, *sides), np.where(z, *sides[::-1])
            mine = (_mixed(cid[c] + 1) % own.astype(np.uint64)).astype(np.int64)
            r = np.repeat(np.arange(len(c)), other)
            theirs = np.arange(len(r)) - np.repeat(np.cumsum(other) - other, other)
            square = np.where(z[r], mine[r] << 32 | theirs, theirs << 32 | mine[r])
            at = _mixed(s[r] ^ _mixed(square + 1).view(np.int64)) % np.uint64(parts * buckets)
            ok = np.flatnonzero(at // np.uint64(buckets) == part)
            at = (at[ok] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            at, square, r = at[order], square[ok[order]], r[ok[order]]
            rows = []
            for bucket in np.unique(at):
                i = slice(*np.searchsorted(at, [bucket, bucket + 1]))
                here, index = np.unique(c[r[i]], return_inverse=True)
                values = (s[r[i]], square[i], index, p[r[i]], z[r[i]], cid[here], n[here], bits[here])
                rows.append((int(bucket), *(v.astype(kind).tobytes() for v, kind in zip(values, _SENT.values()))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows), [pa.int32()] + [pa.binary()] * len(_SENT))], ["bucket", *_SENT])

    return run


def _meet(share: float, most: int = 1 << 17):
    """The pairs of each square that may have more than ``share`` of their words in common; ``most`` bounds the pairs held at a time."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        v = {name: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()] for name, kind in _SENT.items()}
        shift = np.cumsum([0] + [len(x) for x in v["cid"]])[:-1]
        of = np.concatenate([x.astype(np.int64) + d for x, d in zip(v["c"], shift)])
        seed, square, pos, train, cids, words_, bits = (np.concatenate(v[name]) for name in ("s", "square", "p", "z", "cid", "n", "bits"))
        order = np.lexsort((train, square, seed))  # evaluation rows stand before training rows
        seed, square, pos, train, of = (x[order] for x in (seed, square, pos.astype(np.int32), train, of))
        bits, words_ = bits.reshape(len(cids), BITS // 64), words_.astype(np.int64)
        # words beyond the set bits share a bit with another one and may all be common
        more = words_ - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        new = np.append(True, (seed[1:] != seed[:-1]) | (square[1:] != square[:-1]))
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        n_eval = np.bincount(group, train == 0).astype(np.int64)
        left = np.flatnonzero(train)
        count, found = n_eval[group[left]], []
        for part in np.split(left, np.searchsorted(np.cumsum(count), np.arange(most, count.sum(), most))):
            c = n_eval[group[part]]
            a = np.repeat(part, c)
            b = np.repeat(first[group[part]], c) + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
            x, y = of[a], of[b]
            longer = np.maximum(words_[x], words_[y])
            ok = (np.minimum(words_[x], words_[y]) > share * longer) & (x != y) & (cids[x] != cids[y])
            a, b, x, y, longer = a[ok], b[ok], x[ok], y[ok], longer[ok]
            common = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
            ok = common + np.minimum(more[x], more[y]) > share * longer
            found.append((cids[x[ok]], cids[y[ok]], pos[a[ok]], pos[b[ok]]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b", "p", "q"])

    return run


def met_pairs(classes: DataFrame, k: int = K, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``(x, y, s)``: classes x < y, one of training and one of evaluation, that have a fingerprint in common and may be near, with the places of these: 2^32 times that in x, and that in y.

    Batches send their fingerprints to buckets in a few parts, one after the other, so that only a part of them lies on the disk; each part is half as large as the words, or ``PART_BYTES``.
    """
    spark, buckets, slots = classes.sparkSession, _n_batches(classes), int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_grams = cut_lineage(_grams(classes, k))
    release(spark)

    def ask(table, answers):
        b = _Batch(table)
        c, s, p, z = _winnow(b, answers, buckets, k, window, share)
        return _counted(b.batch, s, z, ~z, buckets)

    of_seeds = cut_lineage(_totals(classes.groupBy("batch").cogroup(of_grams.groupBy("batch")).applyInArrow(ask, _COUNTS)))
    release(spark)
    n_seeds, held = of_seeds.agg(F.sum("n_rows")).first()[0] or 0, _held(classes)
    n_squares = max(slots, -(-n_seeds // SQUARE_ROWS))
    parts = max(1, -(-(16 * n_seeds + (12 + BITS // 8) * min(n_seeds, n_squares * held["n"])) // max(PART_BYTES, 2 * held["words"])))
    n_squares = -(-n_squares // parts)

    def keep(table, answers):
        import numpy as np
        import pyarrow.compute as pc

        b = _Batch(table)
        kept = _winnow(b, answers.filter(pc.equal(answers["of"], 0)), buckets, k, window, share)
        u, inv = np.unique(kept[1], return_inverse=True)
        n_t, n_e = _answers(answers.filter(pc.equal(answers["of"], 1)), u, buckets)
        return _kept(b, kept, n_t[inv], n_e[inv])

    both = of_grams.withColumn("of", F.lit(0)).unionByName(of_seeds.withColumn("of", F.lit(1)))
    kept, done = cut_lineage(classes.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(keep, ", ".join(f"{name} binary" for name in _KEPT))), None
    del of_grams, of_seeds, both
    release(spark)
    for part in range(parts):
        sent = kept.mapInArrow(_deal(part, parts, n_squares), "bucket int, " + ", ".join(f"{name} binary" for name in _SENT))
        met = sent.groupBy("bucket").applyInArrow(_meet(share), "a bigint, b bigint, p int, q int")
        one = F.col("a") < F.col("b")
        p, q = F.when(one, F.col("p")).otherwise(F.col("q")), F.when(one, F.col("q")).otherwise(F.col("p"))
        place = F.shiftleft(p.cast("bigint"), 32) + q
        met = cut_lineage(met.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.collect_set(place).alias("s")))
        del sent
        release(spark)
        done = met if done is None else done.unionByName(met)
    return done


def _held(classes: DataFrame):
    """Words and number of the classes."""
    held = classes.agg(F.coalesce(F.sum(F.when(F.col("w").isNotNull(), F.size("w"))), F.lit(0)).alias("words"), F.count("w").alias("n")).first()
    return held


def _lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of one integer."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        u = row & at.get(y, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of seeds (position in a, position in b) that rises in both."""
    import bisect

    seeds = sorted(set(seeds), key=lambda s: (s[0], -s[1]))
    ends, last, back = [], [], {}
    for k, (_, y) in enumerate(seeds):
        j = bisect.bisect_left(ends, y)
        if j == len(ends):
            ends.append(y)
            last.append(k)
        else:
            ends[j], last[j] = y, k
        back[k] = last[j - 1] if j else None
    out, k = [], last[-1] if last else None
    while k is not None:
        out.append(seeds[k])
        k = back[k]
    return out[::-1]


def aligned_words(a: list[int], b: list[int], seeds: list[tuple[int, int]], share: float = SHARE) -> int:
    """Words of ``a`` and ``b`` that stand in the same order: chained seeds (places from 0) and the alignment of the gaps between them.

    Where that leaves the pair below the threshold, the texts are aligned as wholes, so that a wrong seed costs nothing.
    """
    longest = max(len(a), len(b))
    x = y = total = 0
    for p, q in _chain(seeds):
        if p < x or q < y:
            continue
        total += _lcs(a[x:p], b[y:q])
        while p < len(a) and q < len(b) and a[p] == b[q]:
            p, q, total = p + 1, q + 1, total + 1
        x, y = p, q
    total += _lcs(a[x:], b[y:])
    return total if total > share * longest else _lcs(a, b)


def _common(left, right):
    """For each pair of word lists (Arrow lists) the number of words of one that stand in the other, each as often as in both: no more can be aligned."""
    import numpy as np

    keys, counts = [], []
    for side in (left, right):
        owner = np.repeat(np.arange(len(side), dtype=np.uint64), np.diff(side.offsets.to_numpy()))
        word = side.flatten().to_numpy().view(np.uint32).astype(np.uint64)
        k, c = np.unique(owner << np.uint64(32) | word, return_counts=True)
        keys.append(k)
        counts.append(c)
    both, i, j = np.intersect1d(*keys, assume_unique=True, return_indices=True)
    out = np.zeros(len(left), np.int64)
    np.add.at(out, (both >> np.uint64(32)).astype(np.int64), np.minimum(counts[0][i], counts[1][j]))
    return out


def _align(share: float):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held = lambda batch: sum(np.diff(batch.column(k).offsets.to_numpy()) for k in (2, 3, 4))
        for batch in (part for whole in batches for part in _slices(whole, held(whole))):
            sizes = [np.diff(batch.column(k).offsets.to_numpy()) for k in (2, 3)]
            able = _common(batch.column(2), batch.column(3)) > share * np.maximum(*sizes)
            x, y, a, b, s = (batch.column(k).filter(pa.array(able)).to_pylist() for k in range(5))
            got = [aligned_words(p, q, [(z["p"], z["q"]) for z in seeds], share) for p, q, seeds in zip(a, b, s)]
            numbers = [pa.array(v, pa.int32()) for v in (got, [len(z) for z in s], sizes[0][able], sizes[1][able])]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), *numbers], ["x", "y", "aligned", "n_seeds", "nx", "ny"])

    return run


def near_classes(classes: DataFrame, share: float = SHARE, k: int = K, window: int = WINDOW) -> DataFrame:
    """``(x, y, aligned, n_seeds, nx, ny)``: pairs x < y of near classes of which one has training and the other evaluation rows; nx and ny are their words.

    Pairs go to the batch of x and, with its words, to that of y, in parts like those of ``met_pairs``.
    """
    spark = classes.sparkSession
    pairs = cut_lineage(met_pairs(classes, k, window, share).groupBy("x", "y").agg(F.flatten(F.collect_list("s")).alias("s")))
    release(spark)
    n_pairs, held = pairs.count(), _held(classes)
    parts = max(1, -(-4 * n_pairs * held["words"] // max(1, held["n"]) // max(PART_BYTES, 2 * held["words"])))

    def bring(table, asked):
        import pyarrow as pa

        b, asked = _Batch(table), asked.combine_chunks()
        w = b.list.take(pa.array(asked.column("x").to_numpy() & 0xFFFFFFFF))
        return pa.table([pa.array((asked.column("y").to_numpy() >> 32).astype("int32")), asked.column("x"), asked.column("y"), w, asked.column("s").cast(pa.list_(pa.int64()))], ["batch", "x", "y", "wx", "s"])

    def align(table, asked):
        import numpy as np
        import pyarrow as pa

        if not asked.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2 + [pa.array([], pa.int32())] * 4, ["x", "y", "aligned", "n_seeds", "nx", "ny"])
        b, asked = _Batch(table), asked.combine_chunks()
        x, y, wx, s = (asked.column(c).chunk(0) for c in ("x", "y", "wx", "s"))
        places = s.flatten().to_numpy()
        s = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(s.value_lengths().to_numpy())), pa.int32()), pa.StructArray.from_arrays([pa.array((places >> 32).astype("int32")), pa.array((places & 0xFFFFFFFF).astype("int32"))], ["p", "q"]))
        batch = pa.RecordBatch.from_arrays([x, y, wx, b.list.take(pa.array(y.to_numpy() & 0xFFFFFFFF)), s], ["x", "y", "wx", "wy", "s"])
        return pa.Table.from_batches(list(_align(share)(iter([batch]))))

    done = None
    for part in range(parts):
        own = pairs.where(F.pmod(F.xxhash64("x", "y"), F.lit(parts)) == part).select(F.shiftright("x", 32).cast("int").alias("batch"), "x", "y", "s")
        sent = classes.groupBy("batch").cogroup(own.groupBy("batch")).applyInArrow(bring, "batch int, x bigint, y bigint, wx array<int>, s array<bigint>")
        near = classes.groupBy("batch").cogroup(sent.groupBy("batch")).applyInArrow(align, "x bigint, y bigint, aligned int, n_seeds int, nx int, ny int")
        near = cut_lineage(near.where(F.col("aligned") > F.lit(share) * F.greatest("nx", "ny")))
        release(spark)
        done = near if done is None else done.unionByName(near)
    return done


def _directed(classes: DataFrame, near: DataFrame) -> DataFrame:
    """``(train_cid, eval_cid, coverage)``: class links both ways round, and classes that are in both."""
    back = near.select(F.col("y").alias("x"), F.col("x").alias("y"), "aligned", F.col("ny").alias("nx"), F.col("nx").alias("ny"))
    both = near.select("x", "y", "aligned", "nx", "ny").unionByName(back)
    same = class_heads(classes).where("t = 1 and e = 1").select("cid", F.col("cid").alias("eval_cid"), F.lit(1.0))
    return both.select(F.col("x").alias("train_cid"), F.col("y").alias("eval_cid"), (F.col("aligned") / F.col("ny")).alias("coverage")).unionAll(same)


def overlapping_pairs(df: DataFrame, id_col: str, text_col: str, split_col: str, share: float = SHARE, k: int = K, window: int = WINDOW) -> DataFrame:
    """``(id_1, id_2)`` with id_1 < id_2: all pairs of a training and an evaluation row whose texts are the same or nearly so.

    Null or wordless texts and rows without a known split or id are in no pair; repeated rows give one pair.
    """
    members, classes = text_classes(df, id_col, text_col, split_col)
    links = _directed(classes, near_classes(classes, share, k, window)).select("train_cid", "eval_cid")
    train = members.where("split = 'train'").select(F.col("cid").alias("train_cid"), F.col("id").alias("a"))
    rest = members.where("split <> 'train'").select(F.col("cid").alias("eval_cid"), F.col("id").alias("b"))
    pairs = links.join(train, "train_cid").join(rest, "eval_cid").where("a <> b")
    return pairs.select(F.least("a", "b").alias("id_1"), F.greatest("a", "b").alias("id_2")).distinct()


def overlapping_rows(df: DataFrame, id_col: str, text_col: str, split_col: str, share: float = SHARE, k: int = K, window: int = WINDOW) -> DataFrame:
    """``(id_col, split, class_id, n_links, coverage, exact)`` for each evaluation row with an overlap in training.

    ``n_links`` counts the distinct training texts, ``coverage`` is the greatest share of the row's words that one of them holds in order.
    """
    members, classes = text_classes(df, id_col, text_col, split_col)
    links = _directed(classes, near_classes(classes, share, k, window))
    of_class = links.groupBy(F.col("eval_cid").alias("cid")).agg(F.count("*").alias("n_links"), F.max("coverage").alias("coverage"), F.max(F.col("train_cid") == F.col("eval_cid")).alias("exact"))
    rows = lookup(members.where("split <> 'train'"), of_class, "cid")
    return rows.select(F.col("id").alias(id_col), "split", F.col("cid").alias("class_id"), "n_links", "coverage", "exact")


def overlap_report(df: DataFrame, id_col: str, text_col: str, split_col: str, source_col: str) -> DataFrame:
    """Per evaluation split and source: rows, rows with an overlap, exact ones, share and mean coverage. Blank sources are ``unknown``."""
    rows = df.select(F.col(id_col).alias("id"), split_name(split_col).alias("split"), F.upper(F.trim(source_col)).alias("source")).where("split in ('validation', 'test')")
    rows = rows.withColumn("source", F.when(F.coalesce("source", F.lit("")) == "", "unknown").otherwise(F.col("source")))
    found = overlapping_rows(df, id_col, text_col, split_col).select(F.col(id_col).alias("id"), "coverage", "exact").groupBy("id").agg(F.max("coverage").alias("coverage"), F.max("exact").alias("exact"))
    out = rows.join(found, "id", "left").groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count("coverage").alias("n_overlap"), F.count_if("exact").alias("n_exact"), F.avg("coverage").alias("mean_coverage"))
    return out.withColumn("share", F.col("n_overlap") / F.col("n_rows"))
