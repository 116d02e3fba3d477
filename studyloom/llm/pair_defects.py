"""Problem 5: broken prompt and response pairs, by noisy labelling functions and a label model per defect.

Every labelling function votes 1 (defect), -1 (none) or 0 (no opinion). The votes of all pairs are counted by pattern, an
expectation-maximization label model is fitted to the counts for each defect, and a label is kept where its posterior exceeds a
cutoff chosen on held-out patterns."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.lookalikes import UNPLAIN, plainer
from studyloom.llm.truncation import endings
from studyloom.llm.wordlists import FRAME, LANGUAGES, WORD_SETS
from studyloom.plans.lineage import cut, spread

DEFECTS = ("empty", "copy", "refusal", "language", "truncated")
#: Words in at least this share of the questions are the subject's words: at most words-a-question / share of them.
SUBJECT_SHARE = 1e-4
#: An answer with a smaller share of the subject's words is off the subject, one with a larger share on it.
LITTLE, MUCH = 0.1, 0.33
#: An answer about answering has at least this share of words of oneself and of speech.
TELLING = 1 / 30
#: Hash buckets of the letter trigrams of the language model: its size is fixed.
BUCKETS = 1 << 13

_WORD = re.compile(r"[^\W\d_]+|\d+")
_QUOTES = re.compile(r"[“„«\"(\[]")
_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"]*\"|\([^()]*\)|\[[^\[\]]*\]")

# What stands in a field that was left empty.
PLACEHOLDERS = frozenset("na nil none null nan nul void empty blank missing pending tbd tba todo noanswer noresponse notavailable leer vide vacío пусто placeholder xxx undefined".split())
# Ways of declining an answer, and of saying that one does not know, in five languages.
_DECLINE = {
    "en": r"(?:\bi|\bwe|let me|for me|\bme\b|sorry|unfortunately|afraid|assistant|^)\b.{0,40}?(?:can ?not|can't|could not|couldn't|won't|will not|unable|not able|decline|refuse|rather not|isn't possible|not possible|impossible|not allowed|not permitted|do not let|don't let|not in a position|prefer not)\b",
    "de": r"(?:\bich|\bmir|\bleider|\bwir\b|^).{0,60}?(?:\bnicht\b|\bkeine\b|unmöglich|verweiger|lehne).{0,40}|lasse ich aus|tut mir leid",
    "fr": r"ne (?:peux|puis|suis|pouvons|sommes|veux).{0,30}\bpas\b|m'est impossible|impossible de (?:vous |te )?(?:répondre|dire|donner|aider)|désolée?\b|je (?:refuse|passe|décline)|pas (?:autorisé|en mesure)",
    "es": r"no (?:puedo|podemos|me es posible|estoy en condiciones|estoy autorizad|sabría|quiero|debo).{0,40}|lo siento|lamentablemente|imposible (?:responder|contestar)|prefiero no|me niego|\bpaso\b",
    "ru": r"не (?:могу|можем|в состоянии|имею права|буду|хочу|разрешено|получится)|к сожалению|извините|простите|отказываюсь|пропускаю|невозможно ответить",
}
_UNKNOWN = {
    "en": r"(?:don't|do not|doesn't) know|no idea|no clue|\bidk\b|\bdunno\b|not sure what|^pass$|skip this|can't say|who knows",
    "de": r"weiß (?:ich |es )?(?:leider )?nicht|keine ahnung|keine idee|nicht bekannt|\bkeinen schimmer|^weiter$|^passe$",
    "fr": r"(?:ne )?sais pas|aucune idée|pas d'idée|\bjsp\b|^je passe|ignore la réponse",
    "es": r"no (?:lo )?sé|ni idea|no tengo (?:ni )?idea|desconozco|^paso\b",
    "ru": r"не знаю|(?:без|нет) понятия|понятия не имею|не в курсе|нет идей",
}
# Speaking of oneself, and the words an answer about answering is made of.
_SELF = "i i'm i'd i'll i've me my we ich mir mich je j m' moi nous yo me mi мне я меня мы".split()
_SPEECH = (
    r"answer|respon[ds]|help|assist|comment|say anything|request|topic|question|context|antwort|frage|auskunft|helfen|dazu|répon|question|aider|réponse|responder|"
    r"respuesta|contestar|ayudar|solicitud|pregunta|ответ|вопрос|помочь|просьб|сказать"
)
# No pattern above matches a text without one of these, so that most texts need no search.
_NEEDED = {
    "en": "cannot|can not|can't|could not|couldn't|won't|will not|unable|not able|decline|refuse|rather not|possible|not allowed|not permitted|not let|don't let|not in a position|prefer not|know|no idea|no clue|idk|dunno|not sure what|pass|skip this",
    "de": "nicht|keine|unmöglich|verweiger|lehne|lasse ich aus|tut mir leid|weiß|weiter|passe",
    "fr": "pas|impossible|désolé|je refuse|je décline|aucune idée|jsp|ignore la",
    "es": "no p|no m|no e|no s|no q|no d|no lo sé|lo siento|lamentablemente|imposible|prefiero no|me niego|paso|ni idea|no tengo|desconozco",
    "ru": "не |к сожалению|извините|простите|отказываюсь|пропускаю|невозможно|понятия|нет идей",
}
_NEEDED = {lang: tuple(x.split("|")) for lang, x in _NEEDED.items()}
_DECLINE = {lang: re.compile(p) for lang, p in _DECLINE.items()}
_UNKNOWN = {lang: re.compile(p) for lang, p in _UNKNOWN.items()}
SPEECH = re.compile(_SPEECH)
#: What SPEECH matches begins with one of these.
_SPOKEN = tuple(_SPEECH.replace("respon[ds]", "respon").split("|"))
SELF = frozenset(_SELF)


def fold(text: str) -> str:
    """Lower case, composed, without widths and invisible characters; look-alikes stay in their script."""
    if UNPLAIN.search(text):
        text = unicodedata.normalize("NFC", plainer(text).lower())
    return " ".join(text.lower().split())


def declining(text: str) -> tuple[bool, bool]:
    """Whether a folded text declines, and whether it says that it does not know, in any of the languages."""
    has = text.__contains__
    langs = [lang for lang, needed in _NEEDED.items() if any(map(has, needed))]
    return any(_DECLINE[x].search(text) for x in langs), any(_UNKNOWN[x].search(text) for x in langs)


# ---- languages

def trigrams(text: str) -> list[int]:
    text = f" {text} "
    return [xxhash.xxh32_intdigest(text[i : i + 3]) % BUCKETS for i in range(len(text) - 2)]


#: The languages of every closed-class word.
_HITS = {w: tuple(k for k, lang in enumerate(LANGUAGES) if w in WORD_SETS[lang]) for w in FRAME}
_FIRST = itemgetter(0)


def frame_votes(words: list[str]) -> list[int]:
    """Closed-class words of each language among words."""
    votes = [0] * len(LANGUAGES)
    for hits in filter(None, map(_HITS.get, words)):
        for k in hits:
            votes[k] += 1
    return votes


class Languages:
    """Letter trigrams of each language, as log likelihoods by hash bucket."""

    def __init__(self, counts: np.ndarray) -> None:
        self.weight = np.log((counts + 0.3) / (counts + 0.3).sum(axis=1, keepdims=True)).T.copy()

    def scores(self, text: str) -> np.ndarray:
        at = trigrams(text)
        return self.weight[at].sum(axis=0) if at else np.zeros(len(LANGUAGES))


def _trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [Counter() for _ in LANGUAGES]
        subject = Counter()
        for text in batch.column(0).to_pylist():
            low = fold(text)
            words = _WORD.findall(low)
            subject.update({w for w in set(words).difference(_HITS) if not w[0].isnumeric()})
            votes = frame_votes(words)
            first, second = sorted(votes)[:-3:-1]
            if first >= 2 and first > second:
                around = f" {low} "
                counts[votes.index(first)].update(map("".join, zip(around, around[1:], around[2:], strict=False)))
        hashed = Counter()
        for k, seen in enumerate(counts):
            for tri, n in seen.items():
                hashed[k, xxhash.xxh32_intdigest(tri) % BUCKETS] += n
        rows = [("t", f"{k}:{b}", n) for (k, b), n in hashed.items()]
        rows += [("w", w, n) for w, n in subject.items()] + [("n", "", batch.num_rows)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["kind", "key", "n"])


def learn(questions: DataFrame) -> tuple[Languages, frozenset[str]]:
    """From the text of all questions: the language model (a fixed size) and the subject's words (at most words a question
    divided by SUBJECT_SHARE)."""
    counts = cut(questions.filter(F.col("text").isNotNull()).select("text").mapInArrow(_trigram_counts, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total = (counts.filter("kind = 'n'").first() or {"n": 0})["n"]
    table = np.zeros((len(LANGUAGES), BUCKETS))
    for r in counts.filter("kind = 't'").collect():
        a, b = r["key"].split(":")
        table[int(a), int(b)] = r["n"]
    words = counts.filter((F.col("kind") == "w") & (F.col("n") >= max(2, SUBJECT_SHARE * total)))
    return Languages(table), frozenset(r["key"] for r in words.select("key").collect())


# ---- labelling functions

LF_NAMES = {
    "empty": ("no_letter", "placeholder", "no_content"),
    "copy": ("words_covered", "same_text", "trigram_overlap"),
    "refusal": ("declines_or_unknown", "unknown", "off_subject", "about_answering"),
    "language": ("closed_class", "script", "trigrams"),
    "truncated": ("leads_on", "cut_word", "combined"),
}


_CYRILLIC, _LETTER = re.compile(r"[Ѐ-ӿ]"), re.compile(r"[^\W\d_]")


def _share_cyrillic(text: str) -> float:
    if not _CYRILLIC.search(text):
        return 0.0
    return len(_CYRILLIC.findall(text)) / max(1, len(_LETTER.findall(text)))


class Voter:
    """The votes of all labelling functions that look at one pair only."""

    def __init__(self, languages: Languages, subject: frozenset[str]) -> None:
        self.languages, self.subject = languages, frozenset(w for w in subject if not SPEECH.search(w))
        self.question = lru_cache(1 << 12)(self._question)

    def _question(self, text: str) -> tuple:
        low = fold(text)
        words = _WORD.findall(low)
        frame = frame_votes(words)
        lang = frame.index(max(frame)) if sorted(frame)[-1] > sorted(frame)[-2] else int(np.argmax(self.languages.scores(low)))
        return low, "".join(words), frozenset(words), lang, _share_cyrillic(low)

    def votes(self, question: str | None, answer: str | None) -> dict[str, list[int]]:
        low = fold(answer or "")
        words = _WORD.findall(low)
        bare = "".join(words)
        none = not words or bare in PLACEHOLDERS
        out = {"empty": [1 if not words else 0, 1 if bare in PLACEHOLDERS else 0, 1 if none else -1]}
        if none:
            return out | {k: [-1] * len(LF_NAMES[k]) for k in ("copy", "refusal", "language")}
        q_low, q_bare, q_set, lang, q_cyr = self.question(question or "")
        own = _QUOTED.sub(" ", low) if _QUOTES.search(low) else low
        own_words = _WORD.findall(own) if own is not low else words

        # copy: hardly a word that is not the question's, and nearly all of the question's
        inside = sum(map(q_set.__contains__, words)) / len(words)
        if inside < 0.5:
            out["copy"] = [-1, 0, -1]
        else:
            covered = len(q_set.intersection(words)) / max(1, len(q_set))
            a_tri, q_tri = {low[i : i + 3] for i in range(len(low) - 2)}, {q_low[i : i + 3] for i in range(len(q_low) - 2)}
            jac = len(a_tri & q_tri) / max(1, len(a_tri | q_tri))
            out["copy"] = [1 if inside >= 0.8 and covered >= 0.8 else -1, 1 if q_bare and q_bare in bare and inside >= 0.7 else 0, 1 if jac >= 0.7 else -1 if jac < 0.5 else 0]
        # refusal: any answer may decline; how much of it is the subject's is a vote of its own
        about = sum(map(self.subject.__contains__, own_words)) / max(1, len(own_words))
        numbers = any(map(str.isnumeric, map(_FIRST, own_words)))
        declines, unknown = declining(own)
        spoken = len(SPEECH.findall(own)) if any(map(own.__contains__, _SPOKEN)) else 0
        out["refusal"] = [
            1 if declines or unknown else -1,
            1 if unknown else 0,
            -1 if numbers or about >= MUCH else 1 if about < LITTLE else 0,
            1 if own_words and sum(map(SELF.__contains__, own_words)) + spoken >= TELLING * len(own_words) else 0,
        ]
        # language: of what is not quoted
        text, ws = (own, own_words) if own_words else (low, words)
        frame, cyr = frame_votes(ws), _share_cyrillic(text)
        best = max(frame)
        closed = 1 if best - frame[lang] >= 2 and best >= 2 * frame[lang] else -1 if frame[lang] and best <= frame[lang] else 0
        script = 1 if abs(cyr - q_cyr) > 0.6 and max(cyr, q_cyr) > 0.6 else -1 if q_cyr > 0.6 and cyr > 0.4 else 0
        if closed == -1 and script != 1:
            tri = -1
        else:
            s = self.languages.scores(text.strip())
            margin = (s.max() - s[lang]) / max(8, len(text))
            tri = 1 if margin > 0.25 else -1 if margin < 0.08 else 0
        out["language"] = [closed, script, tri]
        return out


_VOTES = "row bigint, " + ", ".join(f"v_{d} array<int>" for d in DEFECTS if d != "truncated")


def _voting(languages: Languages, subject: frozenset[str]):  # noqa: ANN202
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter = Voter(languages, subject)
        for batch in batches:
            rows, q, a = (c.to_pylist() for c in batch.columns)
            found = [voter.votes(x, y) for x, y in zip(q, a, strict=True)]
            cols = [pa.array(rows, pa.int64())] + [pa.array([f[d] for f in found], pa.list_(pa.int32())) for d in DEFECTS if d != "truncated"]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _VOTES.split(", ")])

    return vote


# ---- the label model

class LabelModel:
    """Naive Bayes over votes with a hidden class, fitted by expectation and maximization to pattern counts.

    Accuracies start as those of better-than-chance functions and have prior counts, so that a rare defect cannot make the
    hidden class drift to another meaning."""

    #: P(vote is -1, 0, 1) of a function, without and with the defect, before any data; what these are worth in pairs.
    START = np.array([[0.90, 0.08, 0.02], [0.10, 0.20, 0.70]])
    PRIOR = 50.0

    def __init__(self, prevalence: float = 0.03) -> None:
        self.prevalence = prevalence

    def fit(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
        n = patterns.shape[1]
        self.table = np.repeat(self.START[:, None, :], n, axis=1)
        hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=-1).astype(float)
        for _ in range(rounds):
            p = self.posterior(patterns)
            fresh = np.empty_like(self.table)
            for c, w in enumerate(((1 - p) * counts, p * counts)):
                fresh[c] = (np.einsum("i,ijk->jk", w, hot) + self.PRIOR * self.START[c]) / (w.sum() + self.PRIOR)
            share = ((p * counts).sum() + self.PRIOR * 0.03) / (counts.sum() + self.PRIOR)
            moved = np.abs(fresh - self.table).max() + abs(share - self.prevalence)
            self.table, self.prevalence = fresh, float(share)
            if moved < 1e-6:
                break
        return self

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        if not len(patterns):
            return np.zeros(0)
        at = patterns + 1
        like = [np.log(self.table[c][np.arange(patterns.shape[1])[None, :], at]).sum(axis=1) for c in (0, 1)]
        odds = like[1] - like[0] + np.log(self.prevalence / (1 - self.prevalence))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def best_cutoff(posterior: np.ndarray, counts: np.ndarray) -> float:
    """The cutoff with the highest expected F1 on the given (held-out) patterns, between 0.2 and 0.8; 0.5 without any."""
    best, at = -1.0, 0.5
    total = (posterior * counts).sum()
    for c in np.arange(20, 81, 5) / 100:
        kept = posterior >= c
        f1 = 2 * (posterior * counts)[kept].sum() / max(1e-9, counts[kept].sum() + total)
        if f1 > best + 1e-9 or abs(f1 - best) <= 1e-9 and abs(c - 0.5) < abs(at - 0.5):
            best, at = f1, float(c)
    return at


def defects(pairs: DataFrame, stored: bool = False) -> DataFrame:
    """pairs: row (a unique number), question, answer. Result: row, one posterior p_<defect> each, and labels (an array of the
    defects whose posterior exceeds its cutoff, the likeliest first).

    Null, blank and placeholder answers are empty and nothing else. Null or empty questions: the answer is judged by itself.
    stored: pairs is a table already, read as it is. Texts are read whole. Repeated pairs get equal results; an empty table gives none. Other columns aren't read."""
    pairs = pairs.select("row", "question", "answer")
    pairs = pairs if stored else cut(pairs)
    languages, subject = learn(pairs.filter(F.col("question").isNotNull()).select(F.col("question").alias("text")).distinct())
    voted = spread(pairs).mapInArrow(_voting(languages, subject), _VOTES)
    ends = endings(pairs.select("row", F.col("answer").alias("text")))
    odds = F.col("goes_on") * F.col("word_odds")
    live = (F.col("bare_chars") > 0) & F.col("open")
    three = lambda yes, no: F.when(~live, -1).when(yes, 1).when(no, -1).otherwise(0)
    cut_votes = F.array(three(F.col("goes_on") > 2, F.col("goes_on") < 0.5), three(F.col("word_odds") > 3, F.col("word_odds") < 0.5), three(odds >= 1, odds < 0.5)).alias("v_truncated")
    votes = voted.join(ends.select("row", cut_votes), "row", "left")
    none = F.array(*[F.lit(-1)] * 3)
    is_empty = F.array_contains("v_empty", 1)
    votes = cut(votes.withColumn("v_truncated", F.when(is_empty | F.col("v_truncated").isNull(), none).otherwise(F.col("v_truncated"))))

    out = votes
    cutoffs = {}
    for d in DEFECTS:
        # at most 3 ** functions patterns, each in two halves of the rows
        found = votes.groupBy(F.col(f"v_{d}").alias("v"), (F.xxhash64("row") % 2 == 0).alias("held_out")).count().collect()
        of = lambda side: (np.array([r["v"] for r in found if r["held_out"] == side], dtype=int).reshape(-1, len(LF_NAMES[d])), np.array([r["count"] for r in found if r["held_out"] == side], dtype=float))  # noqa: B023, E731
        model = LabelModel().fit(*of(False))
        held, n_held = of(True)
        cutoffs[d] = best_cutoff(model.posterior(held), n_held)
        every = sorted({tuple(r["v"]) for r in found})
        post = model.posterior(np.array(every, dtype=int).reshape(-1, len(LF_NAMES[d])))
        look = F.create_map(*[x for v, p in zip(every, post.tolist(), strict=True) for x in (F.lit(",".join(map(str, v))), F.lit(p))]) if every else F.create_map(F.lit(""), F.lit(0.0))
        out = out.withColumn(f"p_{d}", F.coalesce(F.try_element_at(look, F.array_join(F.transform(f"v_{d}", lambda x: x.cast("string")), ",")), F.lit(0.0)))
    # what declines and speaks of answering is a refusal first, in whatever language
    leads = lambda d: (F.lit(d == "refusal") & (F.col("v_refusal")[0] == 1) & (F.col("v_refusal")[3] == 1)).cast("int")
    # a label needs a function that votes for it: patterns without any opinion say nothing
    over = F.array(*(F.when((F.col(f"p_{d}") >= cutoffs[d]) & F.array_contains(f"v_{d}", 1), F.struct(leads(d).alias("first"), F.col(f"p_{d}").alias("p"), F.lit(-k).alias("k"), F.lit(d).alias("defect"))) for k, d in enumerate(DEFECTS)))
    labels = F.transform(F.sort_array(F.filter(over, lambda x: x.isNotNull()), asc=False), lambda x: x["defect"])
    return out.select("row", *(f"p_{d}" for d in DEFECTS), labels.alias("labels"))

