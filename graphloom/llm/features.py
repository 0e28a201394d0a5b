"""Dense text features for the toxicity and quality models."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SURFACE = [
    "log_bytes", "log_words", "word_length", "upper", "digits", "punctuation", "exclaims", "questions", "symbols", "marked_words",
    "pipes", "lines", "repeated_lines", "distinct_words", "top_word", "stops", "commas", "beyond_ascii", "upper_words", "shortness",
]
TOXIC = ["hits", "log_hits", "distinct_hits", "directed", "obfuscated", "learned", "learned_most", "stemmed", "stemmed_most", "starred"]

#: words that insult, in a few languages; the learnt list adds what the labels show
LEXICON = frozenset(
    "idiot idiots stupid moron morons dumb scum trash loser losers clown pathetic disgusting worthless filthy garbage hate "
    "idiota imbecil estupido basura asco inutil idiote imbecile ordure nul degoutant connard dumm dummkopf abschaum "
    "widerlich muell versager".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted tus ustedes".split())
STEM = 5  # letters of a word's stem
REACH = 6  # words between an insult and a second person
LEET = [str.maketrans("0134578@$!|", one) for one in ("oieastbasii", "oleastbasll")]
STRIP = string.punctuation + "«»„“”‘’¡¿…"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"$%&*#@|<>{}[]\\^~_=+")] = True
PUNCT = np.zeros(256, bool)
PUNCT[list(string.punctuation.encode())] = True
MARKED = re.compile(r"[a-zA-ZÀ-ɏ][.,]?[$%&*#@^~=+]{2,}|!{2,}")
STARRED = re.compile(r"\b[^\W\d_][*#@]{1,6}[^\W\d_]*\b|\b[^\W\d_]+[*#]{2,6}[^\W\d_]+\b")


def surface(text: str, words: list[str], counted: Counter) -> list[float]:
    raw = text.encode("utf-8", "replace")
    n, w = max(1, len(raw)), max(1, len(words))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, beyond = int(seen[65:91].sum()), int(seen[97:123].sum()), int(seen[128:].sum())
    lines = [x for x in text.split("\n") if x]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), (n - int(seen[[9, 10, 11, 12, 13, 32]].sum())) / w, upper / max(1, upper + lower + beyond / 2),
        int(seen[48:58].sum()) / n, int(seen[PUNCT].sum()) / n, int(seen[33]) / w, int(seen[63]) / w, int(seen[SYMBOLS].sum()) / n,
        len(MARKED.findall(text)) / w, int(seen[124]) / w, len(lines) / w, 1 - len(set(lines)) / max(1, len(lines)), len(counted) / w,
        (max(counted.values()) if counted else 0) / w, int(seen[46]) / w, int(seen[44]) / w, beyond / n,
        sum(k for x, k in counted.items() if len(x) > 2 and x.isupper()) / w, 1 / w,
    ]


def plain_word(word: str) -> str:
    return word.strip(STRIP).lower()


def words_and_stems(text: str) -> set[str]:
    plain = {plain_word(x) for x in text.split()}
    return plain | {x[:STEM] + "*" for x in plain}


def toxic(text: str, words: list[str], counted: Counter, learned: dict[str, float]) -> list[float]:
    w = max(1, len(words))
    hits = Counter()
    hidden, weight, most, stems, most_stem = 0, 0.0, 0.0, 0.0, 0.0
    for word, k in counted.items():
        plain = word.strip(STRIP).lower()
        if plain in LEXICON:
            hits[word] += k
        elif not plain.isalpha() and len(plain) > 2:
            bare = [plain.translate(t) for t in LEET]
            if any(x in LEXICON or "".join(c for c in x if c.isalpha()) in LEXICON for x in bare):
                hidden += k
                hits[word] += k
        odds = learned.get(plain)
        if odds:
            weight += odds * k
            most = max(most, odds)
        odds = learned.get(plain[:STEM] + "*")
        if odds:
            stems += odds * k
            most_stem = max(most_stem, odds)
    total = sum(hits.values())
    directed = 0
    if total:
        persons = {x for x in counted if x.strip(STRIP).lower() in SECOND_PERSON}
        at, of = (np.array([i for i, x in enumerate(words) if x in chosen], np.int64) for chosen in (persons, hits))
        if len(at):  # the first second person that is not too far before a hit
            near = at[np.minimum(np.searchsorted(at, of - REACH), len(at) - 1)]
            directed = int((np.abs(near - of) <= REACH).sum())
    return [total / w, np.log1p(total), len(hits), directed / w, hidden / w, weight / w, most, stems / w, most_stem, len(STARRED.findall(text)) / w if "*" in text or "#" in text or "@" in text else 0.0]


def matrix(texts: list[str | None], learned: dict[str, float] | None) -> np.ndarray:
    """Surface features of each text and, with ``learned`` word weights, the toxicity features after them."""
    rows = []
    for text in texts:
        text = text or ""
        words = text.split()
        counted = Counter(words)
        rows.append(surface(text, words, counted) + (toxic(text, words, counted, learned) if learned is not None else []))
    return np.array(rows, np.float64).reshape(len(texts), len(SURFACE) + (len(TOXIC) if learned is not None else 0))


def labelled_matrix(rows: DataFrame, learned: dict[str, float] | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of (doc_id, text, label) rows, a sample bounded by the caller, in a fixed order."""
    names = SURFACE + (TOXIC if learned is not None else [])

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame(matrix(pdf["text"].tolist(), learned), columns=names)
            out.insert(0, "label", pdf["label"].to_numpy())
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    got = rows.mapInPandas(featurise, ", ".join(["doc_id long", "label int", *(f"{n} double" for n in names)])).toPandas()
    got = got.sort_values(list(got.columns), kind="stable")
    return got[names].to_numpy(np.float64), got["label"].to_numpy(np.float64)


def word_odds(rows: DataFrame, least: int = 4, keep: int = 500) -> dict[str, float]:
    """Log odds of words and stems (their first letters and a star) whose presence speaks for label 1 in (text, label) rows; the strongest ``keep`` of them."""

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"]):
                tally[int(label)].update(words_and_stems(text or ""))
                tally[int(label)][" "] += 1  # documents; no word has a space
        words = list(tally[0].keys() | tally[1].keys())
        if words:
            yield pd.DataFrame({"word": words, "n0": [tally[0][x] for x in words], "n1": [tally[1][x] for x in words]})

    counts = rows.select("text", "label").mapInPandas(present, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    all_ = counts.where(F.col("word") == " ").first()
    if all_ is None or not all_.n0 or not all_.n1:
        return {}
    odds = F.log(((F.col("n1") + 0.5) / (all_.n1 + 1.0)) / ((F.col("n0") + 0.5) / (all_.n0 + 1.0)))
    best = counts.where((F.col("word") != " ") & (F.col("word") != "") & (F.col("n1") >= least)).withColumn("odds", odds).where("odds > 2.0")
    return {r.word: float(r.odds) for r in best.orderBy(F.desc("odds"), "word").limit(keep).collect()}
