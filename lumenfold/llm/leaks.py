"""Evaluation texts inside a training corpus, by template canonicalisation.

Words are the maximal runs of a-z and 0-9 of the lower-cased text. A word is made canonical by itself, whatever its case, its
neighbours, the items or the corpus, so equal passages have equal templates: digits and words for numbers become a number slot,
unit words a unit slot, digits with a unit a slot of their own, and every word that is no plain word of the vocabulary a name slot;
plain words stay. Windows of WINDOW canonical words are hashed over whole texts; a window with fewer than LITERALS words that stay is
hashed by its words themselves, as its template alone says little. Documents' windows are joined with the items' by hash, and those
whose words are equal as well are passages of the item.

For re-parameterised copies digits are parted from letters, and neighbours of one kind of slot are one slot (3.5, twenty five, a
name of several words), so values of another number of words keep the alignment; then the slots of each alignment are checked: its
values must map one to one.

Items are cut into windows on the executors. Only the hashes of their windows go to all tasks, in blocks of about BLOCK_WINDOWS (8
bytes each); more items mean more passes over the documents, not more memory.

Defined results: a null text has no words; an item of fewer words than a window cannot be found; repeated documents are found
each on their own; an empty table of items or documents gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.mixing import tokenizer_path
from lumenfold.operators.skew import frequent, lookup
from lumenfold.session import parallelism, stage

WINDOW = 12
LITERALS = 6
BLOCK_WINDOWS = 1_000_000
#: Windows of all items, with their words, that are broadcast; beyond it they are joined by shuffle.
SMALL_WINDOWS = 200_000
#: Words of the vocabulary that the tasks hold, and distinct words whose canonical forms a task remembers.
MAX_PLAIN, MAX_KNOWN = 1_000_000, 500_000
WORD = re.compile(r"[a-z0-9]+")
#: Words where digits and letters are parted.
PART = re.compile(r"[a-z]+|[0-9]+")
#: Unit words (fixed values).
UNITS = frozenset("b kb mb gb tb kib mib gib ms us ns s sec secs second seconds min mins minute minutes h hour hours day days week weeks month months year years mm cm m km in inch inches ft feet yd yards mile miles mg g kg t lb lbs oz ml l litre litres liter liters percent pct px dpi hz khz mhz ghz bytes bits usd eur gbp dollars euros pounds cents degrees watts volts amps kw kwh mph kmh".split())
#: Words for numbers (fixed values).
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())

NUMBER, NAME, UNIT, MEASURE = 1, 2, 3, 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MEASURE = re.compile(r"[0-9]+([a-z]+)\Z")


def plain_words(path: str) -> frozenset[str]:
    """The words that a vocabulary of ranks holds whole after a space, in lower case and there more often than with a capital."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    words = {t[1:] for t in ranks if re.fullmatch(rb" [a-z]+", t)}
    plain = frozenset(w.decode() for w in words if ranks[b" " + w] < ranks.get(b" " + w.capitalize(), 1 << 62))
    if len(plain) > MAX_PLAIN:
        raise ValueError(f"more than {MAX_PLAIN} plain words")
    return plain


def _mix(ids: np.ndarray) -> np.ndarray:
    h = (ids + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of the windows of size ids, modulo 2**64."""
    n = len(ids) - size + 1
    mixed, out = _mix(ids), np.zeros(max(0, n), np.uint64)
    for i in range(size):
        out = out * _BASE + mixed[i : i + n]
    return out


class Canon:
    """Canonical forms of words, remembered. own[i]: hash of the word with number i; form[i]: the slot it is in, or its hash; a hash is above all slots."""

    def __init__(self, plain: frozenset[str]):
        self.plain, self.number = plain, {}
        self.own, self.form = np.zeros(4096, np.uint64), np.zeros(4096, np.uint64)

    def slot(self, word: str) -> int:
        """The slot of a word, 0 for a plain one."""
        if word.isdigit() or word in NUMBERS:
            return NUMBER
        if word in UNITS:
            return UNIT
        measure = _MEASURE.match(word)
        return MEASURE if measure and measure[1] in UNITS else 0 if word in self.plain else NAME

    def _add(self, word: str) -> int:
        if (i := self.number.get(word)) is None:
            i = self.number[word] = len(self.number)
            if i == len(self.own):
                self.own, self.form = np.append(self.own, np.zeros_like(self.own)), np.append(self.form, np.zeros_like(self.form))
            self.own[i] = int.from_bytes(blake2b(word.encode(), digest_size=8).digest()) | 8
            self.form[i] = self.slot(word) or self.own[i]
        return i

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) > MAX_KNOWN:
            self.number.clear()
        get = self.number.get
        out = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        for i in np.flatnonzero(out < 0):
            out[i] = self._add(words[i])
        return out


def windows(texts: DataFrame, identity: str, text: str, plain: frozenset[str], merged: bool, keys: np.ndarray | None = None) -> DataFrame:
    """(identity, key, pos, words) of the windows of all texts, or of those whose key is among keys (sorted).

    Not merged: windows of words. Merged: of slots and plain words, digits parted from letters, neighbouring slots of one kind in
    one; windows of few plain words are left out.
    """
    schema = texts.select(F.col(identity).alias("identity")).schema.add("key", "long").add("pos", "integer").add("words", "string")
    bits, pattern = 22, PART if merged else WORD

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, table, seen = Canon(plain), keys, np.ones(0, bool)
        if table is not None:
            # A bitmap over the leading bits of the keys spares nearly all searches.
            seen = np.zeros(1 << bits, bool)
            seen[(table >> np.uint64(64 - bits)).astype(np.int64)] = True
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                words: list[str] = []
                ends = []
                for t in b[1].to_pylist():
                    if t:
                        words += pattern.findall(t.lower())
                    ends.append(len(words))
                number, upto = canon.numbers(words), np.array(ends)
                form, first = canon.form[number], None
                if merged:
                    new = np.ones(len(form), bool)
                    new[1:] = (form[1:] != form[:-1]) | (form[1:] > MEASURE)
                    new[upto[upto < len(form)]] = True
                    first = np.flatnonzero(new)
                    form, upto = form[first], np.searchsorted(first, upto)
                if len(form) < WINDOW:
                    continue
                fixed = np.concatenate([[0], np.cumsum(form > MEASURE)])
                rich = fixed[WINDOW:] - fixed[:-WINDOW] >= LITERALS
                key = window_hashes(form, WINDOW)
                if not merged:
                    key = np.where(rich, key, window_hashes(canon.own[number], WINDOW) ^ np.uint64(0x5851F42D4C957F2D))
                hit = np.flatnonzero(rich) if merged else np.arange(len(key))
                if table is not None:
                    hit = hit[seen[(key[hit] >> np.uint64(64 - bits)).astype(np.int64)]]
                    at = np.minimum(np.searchsorted(table, key[hit]), len(table) - 1)
                    hit = hit[table[at] == key[hit]]
                text_of = np.searchsorted(upto, hit, "right")
                inside = hit + WINDOW <= upto[text_of]
                hit, text_of = hit[inside], text_of[inside]
                if not len(hit):
                    continue
                begins = np.concatenate([[0], upto[:-1]])
                if merged:
                    last = np.append(first[1:], len(words))
                    values = [" ".join("+".join(words[first[j] : last[j]]) for j in range(i, i + WINDOW)) for i in hit]
                else:
                    values = [" ".join(words[i : i + WINDOW]) for i in hit]
                yield pa.RecordBatch.from_arrays([b[0].take(pa.array(text_of)), pa.array(key[hit].view(np.int64)), pa.array((hit - begins[text_of]).astype(np.int32)), pa.array(values)], ["identity", "key", "pos", "words"])

    return texts.select(identity, text).mapInArrow(cut, schema)


def window_matches(documents: DataFrame, identity: str, text: str, items: DataFrame, item_id: str, item_text: str, merged: bool = False, vocabulary: str | None = None) -> DataFrame:
    """(identity, item_id, doc_pos, item_pos, doc_words, item_words) of windows with equal templates. vocabulary: file of ranks that tells plain words."""
    plain = plain_words(vocabulary or tokenizer_path())
    known = stage(windows(items, item_id, item_text, plain, merged).select("key", F.col("identity").alias("_item"), F.col("pos").alias("item_pos"), F.col("words").alias("item_words")), "leak-items")
    n = known.count()
    blocks = max(1, -(-n // BLOCK_WINDOWS))
    hits = None
    for at in range(blocks):
        own = known.select("key").filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == at).distinct().toArrow()["key"]
        keys = np.sort(own.to_numpy().view(np.uint64)) if len(own) else np.zeros(1, np.uint64)
        part = windows(documents, identity, text, plain, merged, keys).select("key", F.col("identity").alias("_doc"), F.col("pos").alias("doc_pos"), F.col("words").alias("doc_words"))
        hits = part if hits is None else hits.unionByName(part)
    if n <= SMALL_WINDOWS:
        both = hits.join(F.broadcast(known), "key")
    else:
        hits = stage(hits, "leak-hits")
        hot = frequent(hits, "key", parallelism(hits.sparkSession))  # at most four times as many as tasks
        both = lookup(hits, known, "key", hits.sparkSession.createDataFrame([(h,) for h in hot], "key long") if hot else None, F.struct("_doc", "doc_pos"))
    return both.select(F.col("_doc").alias(identity), F.col("_item").alias(item_id), "doc_pos", "item_pos", "doc_words", "item_words")


def _matches(spark: SparkSession, sf_dir: str, merged: bool) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/eval_items.parquet").select("item_id", "item_text")
    return window_matches(documents, "doc_id", "text", items, "item_id", "item_text", merged)


def leaked(matches: DataFrame, identity: str, item_id: str) -> DataFrame:
    """(item_id, identity) with a window in the item's own words."""
    return matches.filter(F.col("doc_words") == F.col("item_words")).select(item_id, identity).distinct()


def reparameterised(matches: DataFrame, identity: str, item_id: str) -> DataFrame:
    """(item_id, identity, windows, slots): items that a document repeats with other slot values, which map one to one. matches: merged ones.

    A document is compared along each alignment (difference of positions) on its own; windows: those along the best one; slots: its values that differ.
    """
    keys = [item_id, identity, "shift"]
    aligned = matches.withColumn("shift", F.col("doc_pos") - F.col("item_pos"))
    pairs = F.arrays_zip(F.split("item_words", " ").alias("i"), F.split("doc_words", " ").alias("d"))
    # At most as many values as the item has words.
    mapped = aligned.select(*keys, "item_pos", F.explode(pairs).alias("p")).groupBy(*keys).agg(F.count_distinct("item_pos").alias("windows"), F.collect_set("p").alias("pairs"))
    one_to_one = (F.size("pairs") == F.size(F.array_distinct("pairs.i"))) & (F.size("pairs") == F.size(F.array_distinct("pairs.d")))
    judged = mapped.filter(one_to_one).select(*keys, "windows", F.size(F.filter("pairs", lambda p: p["i"] != p["d"])).cast("long").alias("slots"))
    return judged.filter("slots > 0").groupBy(item_id, identity).agg(F.max(F.struct("windows", "slots")).alias("best")).select(item_id, identity, "best.*")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id) of documents that hold 12 consecutive words of an item."""
    return leaked(_matches(spark, sf_dir, False), "doc_id", "item_id")


def p7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id, windows, slots) of documents that repeat an item's template with other numbers, names or units."""
    return reparameterised(_matches(spark, sf_dir, True), "doc_id", "item_id")


QUERIES = {"p7_found": p7_found, "p7_templates": p7_templates}
ORACLES = {
    "p7_found": """
WITH words AS (SELECT item_id, regexp_extract_all(lower(item_text), '[a-z0-9]+') AS w FROM eval_items),
item AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM words WHERE len(w) >= 12)),
doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
doc AS (SELECT doc_id, array_to_string(w[i : i + 11], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM doc_words WHERE len(w) >= 12))
SELECT DISTINCT item_id, doc_id FROM item JOIN doc USING (k)"""
}
