"""Problem 1: one consistent form for text that looks the same but is stored with different characters.

The words of all texts form a vocabulary of attested spellings: words stored in one script, composed, without anything invisible,
counted by the script of the texts they stand in. Its tries, one per shard of looks, are traversed by a weighted edit automaton in
which look-alikes, ignorable characters, widths and ligatures cost nothing and everything else is out of budget. Of the spellings
it reaches the one attested most often in texts of that script is the word's form. Words that reach none are spelled by table."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyloom.llm.lookalikes import SCRIPTS, UNPLAIN, VARIANTS, plainer, script_of, skeleton, spell, unify
from studyloom.plans.lineage import broadcast_if_small, cut, spread

#: Vocabulary words of one trie.
WORDS_A_TRIE = 50_000
#: Rows of one key that one task joins: a word asked for, or a look shared, more often is spread over several tasks.
ROWS_A_KEY = 50_000

_WORD = regex.compile(r"[\p{L}\p{M}\p{Cf}\p{Cn}]+")
words = _WORD.findall  # the maximal runs of letters, marks and invisible characters


@lru_cache(1 << 17)
def parts(word: str) -> tuple[str, tuple[int, int, int]]:
    """A word plainer, and its letters of each script that have no look-alike."""
    own = plainer(word)
    seen = [script_of(ch) for ch in own]
    return own, tuple(seen.count(s) for s in SCRIPTS)


@lru_cache(1 << 17)
def clean(word: str) -> bool:
    """Whether word may be an attested spelling: all its letters are stored in one script, composed, nothing is invisible."""
    if word.isascii():
        return True
    own = unicodedata.normalize("NFD", word)
    if own != parts(word)[0] or unicodedata.normalize("NFC", own) != word:
        return False
    return len({unicodedata.name(ch, "").split(" ")[0] for ch in own if ch.isalpha()}) <= 1


@lru_cache(1 << 17)
def certain(word: str, context: int) -> bool:
    """Whether word is its own form in a text of that script: clean, and either of letters that tell its script or ASCII in a
    Latin text."""
    return clean(word) and (any(parts(word)[1]) or context == 0 and word.isascii())


def context_of(found: list[str]) -> int:
    """The script that most letters without look-alikes are of in these words, as its number in SCRIPTS; the same for all
    texts that look the same."""
    total = [sum(n) for n in zip(*(parts(w)[1] for w in found), strict=True)] if found else [0, 0, 0]
    return max(range(3), key=lambda k: (total[k], -k))


# ---- the automaton

class Trie:
    """Attested spellings with their counts in texts of each script, decomposed letter by letter."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, counts: tuple[int, ...]) -> None:
        node = self.root
        for ch in unicodedata.normalize("NFD", word):
            node = node.setdefault(ch, {})
        node[""] = tuple(map(sum, zip(node.get("", (0, 0, 0)), counts, strict=True)))

    def spellings(self, word: str, budget: int = 0) -> dict[str, tuple[int, ...]]:
        """Every vocabulary word within budget of word, with its counts.

        Costs: 0 for a look-alike, an ignorable character, a width or a ligature; 1 for any other edit."""
        states: dict[tuple[int, str], tuple[dict, int]] = {(id(self.root), ""): (self.root, 0)}
        for step in word:
            for ch in unicodedata.normalize("NFD", plainer(step)):  # none for what is ignorable
                after: dict[tuple[int, str], tuple[dict, int]] = {}
                same = {*VARIANTS.get(ch, {}).values(), ch}
                for (_, path), (node, cost) in states.items():
                    moves = [(x, node[x], cost) for x in same if x in node]
                    if cost < budget:
                        moves += [(x, n, cost + 1) for x, n in node.items() if x and x not in same] + [("", node, cost + 1)]
                    for x, n, c in moves:
                        key = (id(n), path + x)
                        if key not in after or after[key][1] > c:
                            after[key] = (n, c)
                states = after
        return {unicodedata.normalize("NFC", path): node[""] for (_, path), (node, _) in states.items() if "" in node}


def _stored_in(word: str) -> str:
    """The script that the letters of an attested spelling are stored in."""
    return next((unicodedata.name(ch, "").split(" ")[0].lower() for ch in unicodedata.normalize("NFD", word) if ch.isalpha()), "")


def chosen(word: str, reached: dict[str, tuple[int, ...]]) -> list[str | None]:
    """The form of word in texts of each script, of the spellings that the automaton reached; None where there is none.

    A word with letters of one script takes a spelling of that script. In Latin texts a plain spelling goes before all others,
    as texts of plain characters are their own form; else the most frequent in texts of that script, then one in that script, then
    the most frequent in all, then the first."""
    scripts = [s for s, n in zip(SCRIPTS, parts(word)[1], strict=True) if n]
    if len(scripts) > 1:
        return [None, None, None]
    own = {w: n for w, n in reached.items() if not scripts or not (x := {script_of(ch) for ch in plainer(w)} & set(SCRIPTS)) or scripts[0] in x}
    best = lambda k: min(own, key=lambda w: (k == 0 and bool(UNPLAIN.search(w)), -own[w][k], _stored_in(w) != SCRIPTS[k], -sum(own[w]), w), default=None)
    return [best(k) for k in range(3)]


# ---- the jobs

_SCAN = "text_id bigint, a bigint, b bigint, odd_text string, context int, asked array<string>, look string, odd boolean, word string, n_latin bigint, n_cyrillic bigint, n_greek bigint"
_SCAN_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.string(), *[pa.int64()] * 3]
_COUNTS = ["n_latin", "n_cyrillic", "n_greek"]


def two_hashes(text: str) -> tuple[int, int]:
    """128 bits of text as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(text)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the texts: a row for each (hashes; the text where a look-alike may hide in it, its script and the words whose
    form must be found) and one for each word."""
    for batch in batches:
        tokens, rows, asked = Counter(), [], set()
        seen = Counter(), Counter(), Counter()
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            plain = unify(text)
            if not UNPLAIN.search(plain):
                tokens.update(plain.split())
                rows.append((i, *two_hashes(text), text if plain is not text else None, 0, None, None, None, None, None, None, None))
                continue
            found = words(plain)
            k = context_of(found)
            seen[k].update(found)
            ask = [w for w in set(found) if not certain(w, k)]
            asked.update(ask)
            rows.append((i, *two_hashes(text), text, k, ask, None, None, None, None, None, None))
        for tok, n in tokens.items():
            for w in words(tok):
                seen[0][w] += n
        for w in set().union(*seen):
            fine = clean(w)
            rows += [(None, None, None, None, None, None, w if w.isascii() else skeleton(w), odd, w, *(s[w] for s in seen)) for odd in (False, True) if (fine if not odd else w in asked)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 12, _SCAN_TYPES, strict=True)], names=[x.split()[0] for x in _SCAN.split(", ")])


def _spellings(table: pa.Table) -> pa.Table:
    trie, odd = Trie(), {}
    for word, is_odd, *n in zip(*(table.column(c).to_pylist() for c in ("word", "odd", *_COUNTS)), strict=True):
        if is_odd:
            odd[word] = sum(n)
        else:
            trie.add(word, tuple(n))
    rows = [(word, n, *chosen(word, trie.spellings(word))) for word, n in odd.items()]
    return pa.table({k: pa.array([r[i] for r in rows], pa.int64() if k == "n" else pa.string()) for i, k in enumerate(("word", "n", *SCRIPTS))})


def spellings(words_: DataFrame) -> DataFrame:
    """For every word asked for, of (look, odd, word, counts): how often it came, and its form in texts of each script (null: by
    table). Only looks that are asked for go into the tries."""
    asked = words_.filter("odd").select("look").distinct()
    kept = words_.join(asked, "look", "left_semi")
    shards = max(1, -(-asked.count() // WORDS_A_TRIE))
    return kept.withColumn("shard", F.pmod(F.xxhash64("look"), F.lit(shards))).groupBy("shard").applyInArrow(_spellings, "word string, n bigint, " + ", ".join(f"{k} string" for k in SCRIPTS))


def compose(text: str, context: int, known: dict[str, str]) -> str:
    """text of a script with the known forms of its words, everything else by table."""
    text = unify(text)
    if not UNPLAIN.search(text):
        return text
    changed = {w: form for w in set(words(text)) if (form := w if certain(w, context) else known.get(w) or spell(parts(w)[0], SCRIPTS[context])) != w}
    if changed:
        text = _WORD.sub(lambda m: changed.get(m.group(), m.group()), text)
    return unicodedata.normalize("NFC", plainer(text))


@F.pandas_udf(T.StringType())
def _compose(text: pd.Series, context: pd.Series, known: pd.Series) -> pd.Series:
    forms = [{k["word"]: k["form"] for k in of} if of is not None else {} for of in known]
    return pd.Series([None if t is None else compose(t, c, of) for t, c, of in zip(text, context, forms, strict=True)], dtype=object)


def _salted(rows: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    """rows with salt: 0, and for the keys of hot (with salts) a number below their salts."""
    return rows.join(hot.select(key, "salts"), key, "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), "salts").cast("int"))).drop("salts")


def _hot(sized: DataFrame, key: str) -> DataFrame:
    """The keys of sized (key, n) with more rows than one task joins, and over how many keys they are spread."""
    hot = cut(sized.filter(F.col("n") > ROWS_A_KEY).select(key, F.ceil(F.col("n") / ROWS_A_KEY).cast("int").alias("salts")))
    return broadcast_if_small(hot, hot.count(), 100)


def _forms(scan: DataFrame) -> DataFrame:
    """text_id, odd_text and its canonical form, of every text of the scan in which a look-alike may hide."""
    counts = scan.filter(F.col("word").isNotNull()).groupBy("look", "odd", "word").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    known = cut(spellings(cut(counts)))
    hot = _hot(known, "word")
    many = known.join(hot, "word", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts", "n")
    rest = scan.filter(F.col("odd_text").isNotNull()).select("text_id", "odd_text", "context", "asked")
    asked = _salted(rest.select("text_id", "context", F.explode("asked").alias("word")), hot, "word", "text_id")
    form = F.element_at(F.array(*SCRIPTS), F.col("context") + 1)
    found = asked.join(many, ["word", "salt"]).withColumn("form", form).filter(F.col("form").isNotNull()).groupBy("text_id").agg(F.collect_list(F.struct("word", "form")).alias("known"))
    return rest.join(found, "text_id", "left").select("text_id", "odd_text", _compose("odd_text", "context", "known").alias("form"))


def _scanned(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    base = texts.filter(F.col(text).isNotNull()).select(F.col(id_col).cast("bigint").alias("text_id"), F.col(text).alias("text"))
    return cut(spread(base).mapInArrow(_scan, _SCAN))


def canonical(texts: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """texts (id_col a unique number) with a column canonical: equal for two texts exactly when they look the same.

    Case, accents, digits, superscripts, punctuation and the number of blanks are kept. Null text: null canonical. Empty
    text, or text of invisible characters only: ''. Texts of any length are processed whole. Repeated rows and ties give
    the same form, as it depends on the look of the text and on the spellings of all texts. Other columns are passed on; a column
    named canonical is replaced. An empty table gives none."""
    forms = _forms(_scanned(texts, id_col, text)).select(F.col("text_id").alias("_text_id"), F.col("form").alias("_form"))
    return texts.join(forms, F.col(id_col) == F.col("_text_id"), "left").withColumn("canonical", F.coalesce("_form", F.col(text))).drop("_text_id", "_form")


def look_classes(texts: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """The texts that look like one stored differently: text_id, look (128 bits of the canonical form), stored (128 bits of the
    text), n_texts of the class and n_links, how many of them are stored differently. Nulls are in no class."""
    scan = _scanned(texts, id_col, text)
    odd = cut(_forms(scan).select("text_id", _hashes("form").alias("look")))
    stored = scan.filter(F.col("text_id").isNotNull()).select("text_id", F.struct("a", "b").alias("stored"))
    keys = stored.join(odd, "text_id", "left").withColumn("look", F.coalesce("look", "stored"))
    keys = cut(keys.join(odd.select("look").distinct(), "look", "left_semi"))
    forms = keys.groupBy("look", "stored").agg(F.count("*").alias("n_stored"))
    classes = forms.groupBy("look").agg(F.sum("n_stored").alias("n_texts"), F.count("*").alias("n_forms")).filter("n_forms > 1").drop("n_forms")
    sized = forms.join(classes, "look").withColumn("n_links", F.col("n_texts") - F.col("n_stored"))
    return keys.join(sized, ["look", "stored"]).select("text_id", "look", "stored", "n_texts", "n_links")


def same_look(texts: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Pairs (id_a < id_b) of texts that are stored differently and have one canonical form; nulls are in no pair.

    The pairs of look_classes(), by a join on the class; the texts of a large class are spread over several tasks."""
    rows = cut(look_classes(texts, id_col, text).select("text_id", "look", "stored"))
    hot = _hot(rows.groupBy("look").agg(F.count("*").alias("n")), "look")
    a = _salted(rows, hot, "look", "text_id").alias("a")
    b = rows.join(hot, "look", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts").alias("b")
    on = [F.col("a.look") == F.col("b.look"), F.col("a.salt") == F.col("b.salt"), F.col("a.text_id") < F.col("b.text_id"), F.col("a.stored") != F.col("b.stored")]
    return a.join(b, on).select(F.col("a.text_id").alias("id_a"), F.col("b.text_id").alias("id_b"))


@F.pandas_udf(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
def _hashes(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([two_hashes(x) for x in s], columns=["a", "b"])
