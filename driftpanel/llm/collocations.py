"""Phrase collocations from depth-truncated suffix subtrees, built group by group after a vertical partitioning of word prefixes.

A suffix is the text that begins at one word; it is cut after four words, at the end of its piece,
and before a word that is too rare to be part of any phrase. Suffixes are divided by their prefixes:
prefixes that begin too many suffixes for the memory budget are lengthened by a word, the others are
packed into groups within the budget. One task builds the subtrees of one group, and the counts
of all its phrases are the totals of the leaves below their nodes.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftpanel.llm.tables import attach, cut_lineage

#: Candidates have up to so many words and occur so often.
LONGEST = 4
LEAST = 30
SCALE = 2_000_000
#: A phrase goes if a longer one around it has this share of its occurrences, in percent.
COVERED = 80
TOP = 2000
#: Suffixes of one group, and positions that a map task holds before it sends them.
GROUP_SUFFIXES = 1 << 20
CHUNK = 1 << 20
#: Bytes of text that are split together, distinct words that a counting task holds.
SLICE = 4 << 20
HELD_WORDS = 400_000
#: Bits of the word filter: fixed, so what tasks are sent does not grow with the text (2 MB).
FILTER_BITS = 24
ODD = 0x9E3779B97F4A7C15
_LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: A-Z to a-z, all ends of a piece to one mark that no word holds, tab to space.
TABLE = bytes.maketrans(_LOWER[0] + b",;:!?\n\x0b\x0c\r\t", _LOWER[1] + b"." * 9 + b" ")
PACK = "band int, lang string, a binary, b binary, c binary, d binary, n binary"


def split_words(texts: list[bytes], slice_bytes: int = SLICE):
    """Words of all texts in a row, list by list; the word ``.`` stands for the end of a piece and of a text."""
    data = b".".join([*texts, b""]).translate(TABLE)
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > slice_bytes:
            end = data.rfind(b" ", at, at + slice_bytes) + 1 or data.find(b" ", at + slice_bytes) + 1 or end
        yield data[at:end].replace(b".", b" . ").split()
        at = end


class _Words:
    """Numbers and 64-bit hashes of the words of one language; number 0 is the end of a piece, hash 0 no word."""

    def __init__(self, lang: str, salt: int):
        import numpy as np
        import xxhash

        self.seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), salt)
        self.index = defaultdict(itertools.count(1).__next__, {b".": 0})
        self.hashes = np.zeros(1, np.uint64)

    def numbers(self, words: list[bytes]):
        import numpy as np
        import xxhash

        ids = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        new = list(itertools.islice(self.index, len(self.hashes), None))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, self.seed) or 1 for w in new), np.uint64, len(new))
        self.hashes = np.r_[self.hashes, hashes]
        return ids


def _by_language(batches, slice_bytes: int = SLICE):
    """``lang, text`` batches to lists of texts of one language, of about ``slice_bytes`` or one text."""
    import pyarrow as pa

    held, sizes = defaultdict(list), defaultdict(int)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            text = text.as_py() or b""
            held[lang].append(text)
            sizes[lang] += len(text)
            if sizes[lang] >= slice_bytes:
                yield lang, held.pop(lang)
                del sizes[lang]
    yield from held.items()


def _counted(salt: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        tables: dict[str, tuple] = {}

        def flushed():
            for lang, (words, counts) in tables.items():
                if len(words.hashes) > 1:
                    names = list(words.index)[1:]
                    columns = [pa.array([lang] * len(names), pa.string()), pa.array(names, pa.binary()), pa.array(words.hashes[1:].view(np.int64)), pa.array(counts[1:])]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "hash", "n"])
            tables.clear()

        for lang, texts in _by_language(batches):
            for part in split_words(texts):
                words, counts = tables.get(lang) or (_Words(lang, salt), np.zeros(1, np.int64))
                ids = words.numbers(part)
                tables[lang] = words, np.r_[counts, np.zeros(len(words.hashes) - len(counts), np.int64)] + np.bincount(ids, minlength=len(words.hashes))
                if sum(len(w.hashes) for w, _ in tables.values()) > HELD_WORDS:
                    yield from flushed()
        yield from flushed()

    return run


def word_counts(texts: DataFrame, salt: int = 0) -> DataFrame:
    """``lang, word, hash, n`` of every word; words are added up in the map tasks first."""
    found = texts.mapInArrow(_counted(salt), "lang string, word binary, hash long, n long")
    return found.groupBy("lang", "word").agg(F.first("hash").alias("hash"), F.sum("n").alias("n"))


def word_filter(frequent: DataFrame) -> bytes:
    """One bit for each value of the leading bits of a hash: set where a frequent word has them."""
    place = F.shiftrightunsigned("hash", 64 - FILTER_BITS) + 1
    parts = frequent.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    size = 4096
    out = bytearray(max(1 << FILTER_BITS >> 3, size))
    for row in parts.collect():
        out[(row.k - 1) * size : row.k * size] = row.bits
    return bytes(out)


def _lengthened(prefix, word):
    """Hash of a prefix with one more word."""
    import numpy as np

    h = (prefix ^ (word + np.uint64(ODD))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


class Plan:
    """Which group a suffix belongs to.

    ``bands[k]`` gives the group of each bucket of prefixes of k + 1 words, -1 where prefixes are
    lengthened; longest prefixes that still are too many go into ``last`` by hash. Groups of longer prefixes
    have higher numbers, and ``firsts[k]`` is the first group of prefixes of k + 1 words.
    """

    def __init__(self, buckets: int):
        self.buckets, self.bands, self.firsts, self.groups, self.last = buckets, [], [], 0, 0

    def add(self, loads, budget: int) -> None:
        """Pack the buckets of the next length within the budget; heavier buckets stay open."""
        import numpy as np

        fits = loads <= budget
        before = np.cumsum(np.where(fits, loads, 0)) - np.where(fits, loads, 0)
        self.firsts.append(self.groups)
        self.bands.append(np.where(fits, self.groups + before // budget, -1).astype(np.int32))
        self.groups = max(self.groups, int(self.bands[-1].max(initial=-1)) + 1)

    def close(self, load: int, budget: int) -> None:
        self.firsts.append(self.groups)
        self.last = load // budget + 1
        self.groups += self.last

    def open(self, level: int, prefix):
        import numpy as np

        return self.bands[level][(prefix & np.uint64(self.buckets - 1)).astype(np.int64)] < 0

    def group(self, words):
        """Group of each suffix; ``words`` are the hash columns, 0 for none."""
        import numpy as np

        prefix, out = words[0], np.full(len(words[0]), -1, np.int32)
        for level, band in enumerate(self.bands):
            if level:
                prefix = _lengthened(prefix, words[level])
            left = out < 0
            if not left.any():
                return out
            out[left] = band[(prefix[left] & np.uint64(self.buckets - 1)).astype(np.int64)]
        left = out < 0
        prefix = _lengthened(prefix, words[LONGEST - 1])
        out[left] = self.firsts[-1] + (prefix[left] % np.uint64(max(self.last, 1))).astype(np.int32)
        return out

    def length(self, group: int) -> int:
        """Words of the prefixes that a group holds whole."""
        return sum(group >= f for f in self.firsts)


def _chunks(batches, salt: int, bits: bytes, chunk: int):
    """``lang, words, numbers``: runs of word numbers with rare words as 0; three positions are carried to the next run of a language."""
    import numpy as np

    flags = np.frombuffer(bits, np.uint8)
    held: dict[str, tuple] = {}

    def run_of(lang):
        words, parts = held[lang]
        ids = np.concatenate(parts)
        tail = ids[len(ids) - LONGEST + 1 :]
        if len(words.hashes) > HELD_WORDS:
            # a new table for what comes; the carried words get numbers in it
            names, fresh = list(words.index), _Words(lang, salt)
            held[lang] = fresh, [fresh.numbers([names[i] for i in tail.tolist()])]
        else:
            held[lang] = words, [tail]
        return lang, words, ids

    for lang, texts in _by_language(batches):
        for part in split_words(texts):
            words, parts = held.get(lang) or (_Words(lang, salt), [])
            ids = words.numbers(part)
            place = (words.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            frequent = (flags[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            frequent[0] = 0
            held[lang] = words, [*parts, np.where(frequent[ids] == 1, ids, 0)]
            if sum(map(len, held[lang][1])) >= chunk + LONGEST:
                yield run_of(lang)
    for lang, (words, parts) in held.items():
        yield lang, words, np.concatenate([*parts, np.zeros(LONGEST - 1, np.int64)])


def _suffixes(words, ids):
    """Distinct suffixes of a run as hash columns, and how often each occurs; suffixes of one word are left out."""
    import numpy as np

    at = np.flatnonzero((ids[: 1 - LONGEST] > 0) & (ids[1 : len(ids) - LONGEST + 2] > 0))
    a, b, c, d = (ids[at + k] for k in range(LONGEST))
    d = np.where(c > 0, d, 0)
    wide = len(words.hashes)
    front, back = a * wide + b, c * wide + d
    order = np.lexsort((back, front))
    front, back = front[order], back[order]
    first = np.flatnonzero(np.r_[True, (front[1:] != front[:-1]) | (back[1:] != back[:-1])][: len(front)])
    n = np.diff(np.r_[first, len(front)]).astype(np.int64)
    pick = order[first]
    hashes = words.hashes.copy()
    hashes[0] = 0
    return [hashes[x[pick]] for x in (a, b, c, d)], n


def _measured(salt: int, bits, plan: Plan, chunk: int):
    """Suffixes in open buckets of one word, counted by buckets of two and of three words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        loads = np.zeros((2, plan.buckets), np.int64)
        for _, words, ids in _chunks(batches, salt, bits.value, chunk):
            columns, n = _suffixes(words, ids)
            some = plan.open(0, columns[0])
            prefix, n = columns[0][some], n[some]
            for k in (1, 2):
                prefix = _lengthened(prefix, columns[k][some])
                bucket = (prefix & np.uint64(plan.buckets - 1)).astype(np.int64)
                loads[k - 1] += np.bincount(bucket, weights=n, minlength=plan.buckets).astype(np.int64)
        level, bucket = np.nonzero(loads)
        yield pa.RecordBatch.from_arrays([pa.array(level.astype(np.int32)), pa.array(bucket), pa.array(loads[level, bucket])], ["level", "bucket", "n"])

    return run


def _packed(salt: int, bits, plan, chunk: int):
    """Texts to packs of suffixes by group, equal suffixes of a run counted."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for lang, words, ids in _chunks(batches, salt, bits.value, chunk):
            columns, n = _suffixes(words, ids)
            if not len(n):
                continue
            group = plan.value.group(columns)
            order = np.argsort(group, kind="stable")
            group = group[order]
            columns = [x[order] for x in (*columns, n)]
            start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            ends = np.r_[start[1:], len(group)]
            packs = [pa.array([x[s:e].tobytes() for s, e in zip(start.tolist(), ends.tolist(), strict=True)], pa.binary()) for x in columns]
            yield pa.RecordBatch.from_arrays([pa.array(group[start]), pa.array([lang] * len(start), pa.string()), *packs], [c.split()[0] for c in PACK.split(", ")])

    return run


def subtree_nodes(columns, n, exact: int, least: int):
    """Nodes of two words and more: position of a suffix below, depth, and total of the leaves below.

    ``columns`` are sorted. Nodes at or below the depth ``exact`` are whole here, so rare ones go; those above
    get further leaves from other groups.
    """
    import numpy as np

    new = np.r_[True, np.zeros(len(n) - 1, bool)]
    for depth, x in enumerate(columns, start=1):
        new[1:] |= x[1:] != x[:-1]
        start = np.flatnonzero(new)
        if depth == 1:
            continue
        total = np.add.reduceat(n, start)
        kept = (x[start] != 0) & ((total >= least) if depth >= exact else True)
        yield start[kept], depth, total[kept]


def _grown(plan, least: int):
    """Packs in order of their groups to nodes ``lang, a, b, c, d, n``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def nodes(group, packs):
            langs = sorted({p[0] for p in packs})
            lang = np.concatenate([np.full(len(p[5]) >> 3, langs.index(p[0]), np.int32) for p in packs])
            columns = [np.frombuffer(b"".join(p[k] for p in packs), np.int64) for k in range(1, 6)]
            order = np.lexsort(columns[3::-1])
            lang, (*columns, n) = lang[order], [x[order] for x in columns]
            for at, depth, total in subtree_nodes(columns, n, plan.value.length(group), least):
                hashes = [pa.array(x[at] if k < depth else np.zeros(len(at), np.int64)) for k, x in enumerate(columns)]
                names = pa.DictionaryArray.from_arrays(pa.array(lang[at]), pa.array(langs, pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names, *hashes, pa.array(total)], ["lang", "a", "b", "c", "d", "n"])

        now, packs = None, []
        for batch in batches:
            for group, *pack in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if group != now:
                    if packs:
                        yield from nodes(now, packs)
                    now, packs = group, []
                packs.append(pack)
        if packs:
            yield from nodes(now, packs)

    return run


def phrase_counts(texts: DataFrame, frequent: DataFrame, salt: int, least: int = LEAST, group_suffixes: int = GROUP_SUFFIXES, chunk: int = CHUNK) -> DataFrame:
    """``lang, a, b, c, d, n``: word hashes (0 for none) and count of every phrase of two to four words with ``least`` occurrences."""
    import numpy as np

    context = texts.sparkSession.sparkContext
    bits = context.broadcast(word_filter(frequent))
    total = frequent.agg(F.sum("n")).first()[0] or 0
    plan = Plan(1 << max(8, (16 * total // group_suffixes).bit_length()))
    loads = np.zeros(plan.buckets, np.int64)
    for row in frequent.groupBy(F.col("hash").bitwiseAND(plan.buckets - 1).alias("k")).agg(F.sum("n").alias("n")).collect():
        loads[row.k] = row.n
    plan.add(loads, group_suffixes)
    if (plan.bands[0] < 0).any():
        further = np.zeros((2, plan.buckets), np.int64)
        measured = texts.mapInArrow(_measured(salt, bits, plan, chunk), "level int, bucket long, n long")
        for row in measured.groupBy("level", "bucket").agg(F.sum("n").alias("n")).collect():
            further[row.level, row.bucket] = row.n
        plan.add(further[0], group_suffixes)
        plan.add(further[1], group_suffixes)
        plan.close(int(further[1][plan.bands[2] < 0].sum()), group_suffixes)
    shared = context.broadcast(plan)
    packs = texts.mapInArrow(_packed(salt, bits, shared, chunk), PACK)
    dealt = packs.repartition(max(plan.groups, 1), "band").sortWithinPartitions("band")
    nodes = dealt.mapInArrow(_grown(shared, least), "lang string, a long, b long, c long, d long, n long")
    return nodes.groupBy("lang", "a", "b", "c", "d").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _part(start: int, size: int) -> Column:
    """Words ``start`` to ``start + size`` of a phrase, as a phrase."""
    return F.struct(*[(F.col(f"p.{'abcd'[start + k]}") if k < size else F.lit(0).cast("long")).alias("abcd"[k]) for k in range(LONGEST)])


def _size() -> Column:
    return F.when(F.col("p.c") == 0, 2).when(F.col("p.d") == 0, 3).otherwise(4)


def _wide(c: str) -> str:
    return f"CAST({c} AS DECIMAL(19, 0))"


def scored(phrases: DataFrame, frequent: DataFrame, scale: int = SCALE, covered: int = COVERED) -> DataFrame:
    """``lang, p, a, l, r, score`` of the phrases that no longer phrase covers; the lowest cut of each, then the first."""
    candidates = phrases.select("lang", F.struct("a", "b", "c", "d").alias("p"), F.col("n").alias("a"))
    sizes = [(size, cut) for size in range(2, LONGEST + 1) for cut in range(1, size)]
    sides = [
        F.when(_size() == size, F.struct(F.lit(cut).alias("cut"), F.lit(side).alias("side"), _part(*span).alias("key")))
        for size, cut in sizes
        for side, span in enumerate([(0, cut), (cut, size - cut)])
    ]
    parts = candidates.select("lang", "p", "a", F.inline(F.filter(F.array(*sides), lambda x: x.isNotNull())))
    zero = F.lit(0).cast("long")
    known = frequent.select(F.struct(F.col("hash").alias("a"), zero.alias("b"), zero.alias("c"), zero.alias("d")).alias("key"), F.col("n").alias("f"))
    known = known.unionByName(candidates.select(F.col("p").alias("key"), F.col("a").alias("f")))
    parts = cut_lineage(parts)
    wanted = parts.groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    # a word that very many phrases begin with is joined by broadcast, see attach
    found = attach(parts, cut_lineage(known.join(wanted, "key")), "key", parts.count(), "uses")
    cuts = found.groupBy("lang", "p", "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr(f"({scale}BD * {_wide('a')}) div ({_wide('l')} + {_wide('r')})")
    best = cuts.groupBy("lang", "p", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    inner = [
        F.when(_size() == size, _part(start, inside)) for size in range(3, LONGEST + 1) for inside in range(2, size) for start in range(size - inside + 1)
    ]
    around = candidates.where("p.c != 0").select(F.explode(F.filter(F.array(*inner), lambda x: x.isNotNull())).alias("p"), F.col("a").alias("around"))
    around = around.groupBy("p").agg(F.max("around").alias("around"))
    kept = best.join(around, "p", "left").where(F.expr(f"around IS NULL OR 100BD * {_wide('around')} < {covered}BD * {_wide('a')}"))
    return kept.select("lang", "p", "a", "best.l", "best.r", "best.score")


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, group_suffixes: int = GROUP_SUFFIXES, chunk: int = CHUNK, scale: int = SCALE, covered: int = COVERED
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` collocations of each language of ``docs`` (``lang, text``).

    A-Z are lower-cased, texts are split at ``.,;:!?`` and line ends into pieces and these at spaces
    and tabs into words. Null and empty texts have no words, a null language is ``und``; repeated rows
    count as often as they are there. All counts are exact: words are told apart by 64-bit hashes that are checked
    to be distinct (another salt is taken if not), and no phrase, suffix or text is left out. Ranks go by
    score, then count, both descending, then by phrase in byte order. No rows give no rows.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    for salt in itertools.count():
        words = cut_lineage(word_counts(texts, salt))
        frequent = cut_lineage(words.where(F.col("n") >= least))
        if not frequent.groupBy("hash").count().where("count > 1").take(1):
            break
    phrases = cut_lineage(phrase_counts(texts, frequent, salt, least, group_suffixes, chunk))
    by_score = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    first = cut_lineage(scored(phrases, frequent, scale, covered).withColumn("place", F.rank().over(by_score)).where(F.col("place") <= top).drop("place"))
    spelt = first.select("p", F.posexplode(F.array("p.a", "p.b", "p.c", "p.d")).alias("k", "hash")).where("hash != 0")
    spelt = spelt.join(frequent.select("hash", F.col("word").cast("string").alias("word")), "hash")
    spelt = spelt.groupBy("p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    whole = first.join(spelt, "p").join(n, "lang").withColumn("rank", F.row_number().over(ranked).cast("long")).where(F.col("rank") <= top)
    return whole.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
