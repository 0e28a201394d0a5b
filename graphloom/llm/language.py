"""Language identification with interpolated Kneser-Ney character models.

Texts become lower-case letters with single spaces between runs of them.  For each language an interpolated
Kneser-Ney model of ``ORDER`` characters is estimated.  All models share sorted arrays of n-gram hashes: one of
predicted n-grams with a log probability per language, one of contexts with a back-off weight per language, for
each order.  The language with the lowest cross-entropy per character wins; a cross-entropy far above what that
language shows in training is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import fold_is, materialise, slices, table, unused

ORDER = 4
#: documents of each language that the models are estimated from, and characters in them, at most: texts in the order of a
#: hash of the id while the characters before them are fewer.  All languages together share a budget of characters.
TRAINING_ROWS, TRAINING_CHARS, TOTAL_CHARS = 1_000, 4_000_000, 16_000_000
#: languages that are learnt, at most: those with the most training rows
LANGUAGES = 500
#: characters of a text that take part in the sample, at most, from its middle (scored is every text as a whole)
LONGEST_SAMPLED = 1_000_000
CHARS_AT_ONCE = 1 << 19
#: letters below which a text's cross-entropy is no ground for rejection
FEW = 30
SPACE = 32
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def code_runs(text: str | None) -> Iterator[np.ndarray]:
    """Code points of the lower-cased letters, runs of anything else as one space, a space at either end; in pieces of
    at most about ``CHARS_AT_ONCE``, however long the text is."""
    lower, known, last = (text or "").lower(), letters(), None
    for at in range(0, max(1, len(lower)), CHARS_AT_ONCE):
        raw = np.frombuffer(lower[at : at + CHARS_AT_ONCE].encode("utf-32-le", "replace"), np.uint32)
        raw = np.where(known[np.minimum(raw, len(known) - 1)], raw, SPACE).astype(np.uint64)
        if at == 0:
            raw = np.r_[np.uint64(SPACE), raw]
        if at + CHARS_AT_ONCE >= len(lower):
            raw = np.r_[raw, np.uint64(SPACE)]
        raw = raw[np.r_[(raw[:1] != SPACE) | (last != SPACE), (raw[1:] != SPACE) | (raw[:-1] != SPACE)]]
        if len(raw):
            last = raw[-1]
            yield raw


def codes(text: str | None) -> np.ndarray:
    """All of a text's codes at once."""
    return np.concatenate(list(code_runs(text)))


def grams(c: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each position; positions before the first whole n-gram see spaces."""
    h = np.zeros(len(c), np.uint64)
    for back in range(n - 1, -1, -1):
        shifted = c if not back else np.r_[np.full(min(back, len(c)), SPACE, np.uint64), c[: max(0, len(c) - back)]]
        h = (h ^ shifted) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


@dataclass
class LanguageModels:
    langs: list[str]
    floor: np.ndarray  # log probability of an unseen character
    seen: list[tuple[np.ndarray, np.ndarray]]  # for orders 1..ORDER: sorted hashes, log probabilities
    back: list[tuple[np.ndarray, np.ndarray]]  # for orders 2..ORDER: sorted context hashes, log back-off weights
    sharpness: float = 20.0
    worst: float = np.inf  # highest accepted cross-entropy

    def log_probs(self, c: np.ndarray) -> np.ndarray:
        """Natural log probability of each character under each language."""
        out = np.zeros((len(c), len(self.langs)), np.float32)
        left = np.arange(len(c))
        for n in range(ORDER, 0, -1):
            h = grams(c, n)[left]
            keys, rows = self.seen[n - 1]
            at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            found = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            out[left[found]] += rows[at[found]]
            left = left[~found]
            if not len(left):
                return out
            if n > 1:
                keys, rows = self.back[n - 2]
                before = np.r_[np.uint64(SPACE), c[:-1]]
                h = grams(before, n - 1)[left]
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                found = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                out[left[found]] += rows[at[found]]
        out[left] += self.floor
        return out

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log probability per character (texts x languages), and the number of letters."""
        sums, chars, held, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), [], 0

        def flush() -> None:
            if held:
                p = self.log_probs(np.concatenate([x for _, before, c in held for x in (before, c)]))
                sizes = np.array([len(c) for _, _, c in held])
                starts = np.cumsum(np.r_[0, sizes[:-1] + ORDER]) + ORDER
                bounds = np.stack([starts, starts + sizes], 1).ravel()
                total = np.add.reduceat(np.concatenate([p, np.zeros((1, p.shape[1]), np.float32)]), bounds, axis=0, dtype=np.float64)[::2]
                np.add.at(sums, [i for i, _, _ in held], total)
                held.clear()

        pad = np.full(ORDER, SPACE, np.uint64)
        for i, text in enumerate(texts):
            before = pad  # the characters that a run's first ones follow
            for c in code_runs(text):
                chars[i] += int((c != SPACE).sum())
                if n and n + len(c) > CHARS_AT_ONCE:
                    flush()
                    n = 0
                held.append((i, before, c))
                n += len(c)
                before = np.r_[before, c[-ORDER:]][-ORDER:]
        flush()
        sums[chars == 0] = 0
        return -sums / np.maximum(1, chars)[:, None], chars

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language (``und`` without letters or models), score from 0 to 1, and whether it is accepted."""
        entropy, chars = self.cross_entropy(texts)
        if not self.langs:
            return np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), bool)
        best = entropy.argmin(1) if len(texts) else np.zeros(0, np.int64)
        odds = np.exp(-self.sharpness * (entropy - entropy.min(1, keepdims=True)))
        score = odds[np.arange(len(texts)), best] / odds.sum(1)
        known = chars > 0
        lang = np.where(known, np.array(self.langs, object)[best], "und")
        fits = known & ((entropy[np.arange(len(texts)), best] <= self.worst) | (chars < FEW))
        return lang, np.where(known, score, 0.0), fits


def _kneser_ney(counts: pd.DataFrame, langs: list[str]) -> LanguageModels:
    """Models of (lang number, order, context hash, gram hash, n) rows; order ``ORDER`` has counts, lower orders
    how many characters were seen before the n-gram."""
    size = len(langs)
    parts = {n: counts[counts["n"] == n] for n in range(1, ORDER + 1)}
    letters_seen = max(1, parts[1]["gram"].nunique()) + 1
    floor = np.zeros(size)
    seen, back = [], []
    lower: dict | None = None
    for n in range(1, ORDER + 1):
        part = parts[n]
        keys, at = np.unique(part["gram"].to_numpy(np.uint64), return_inverse=True)
        grid = np.zeros((len(keys), size))
        np.add.at(grid, (at, part["lang"].to_numpy(np.int64)), part["k"].to_numpy(np.float64))
        first = np.unique(at, return_index=True)[1]
        contexts, of = np.unique(part["context"].to_numpy(np.uint64)[first], return_inverse=True)
        shorter = part["shorter"].to_numpy(np.uint64)[first]
        ones, twos = (grid == 1).sum(0), (grid == 2).sum(0)
        discount = np.clip(ones / np.maximum(1, ones + 2 * twos), 0.1, 0.95)
        total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
        np.add.at(total, of, grid)
        np.add.at(kinds, of, (grid > 0).astype(float))
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        below = np.full((len(keys), size), 1.0 / letters_seen) if n == 1 else lower_prob(lower, shorter, size)
        prob = np.maximum(grid - discount, 0) / np.maximum(total, 1)[of] + weight[of] * below
        if n == 1:
            floor = np.log(np.maximum(weight[0] if len(weight) else np.ones(size), 1e-9) / letters_seen)
        seen.append((keys, np.log(np.maximum(prob, 1e-12)).astype(np.float32)))
        if n > 1:
            back.append((contexts, np.log(np.maximum(weight, 1e-12)).astype(np.float32)))
        lower = {"keys": keys, "prob": prob}
    return LanguageModels(langs, floor.astype(np.float32), seen, back)


def lower_prob(lower: dict, hashes: np.ndarray, size: int) -> np.ndarray:
    """Probabilities one order down; every suffix of a seen n-gram was seen."""
    return lower["prob"][np.searchsorted(lower["keys"], hashes)] if len(lower["keys"]) else np.zeros((len(hashes), size))


def _count(rows: DataFrame, langs: list[str]) -> pd.DataFrame:
    """N-gram counts of (text, lang) rows, summed over the cluster; as many rows as distinct n-grams of the sample."""
    number = {x: k for k, x in enumerate(langs)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, group in pdf.groupby("lang", sort=False):
                pad, lines = np.full(ORDER, SPACE, np.uint64), [codes(t) for t in group["text"]]  # bounded like the sample
                c = np.concatenate([x for line in lines for x in (pad, line)])
                own = np.concatenate([np.r_[np.zeros(ORDER, bool), np.ones(len(line), bool)] for line in lines])
                before = np.r_[np.uint64(SPACE), c[:-1]]
                g, h = (np.stack([grams(x, n)[own] for n in orders]) for x, orders in ((c, range(1, ORDER + 1)), (before, range(1, ORDER))))
                rows_, first, k = np.unique(g[ORDER - 1], return_index=True, return_counts=True)
                out = {"lang": number[lang], "k": k}
                for n in range(1, ORDER + 1):
                    out[f"g{n}"] = g[n - 1][first].view(np.int64)
                    out[f"c{n}"] = (h[n - 2][first] if n > 1 else np.zeros(len(first), np.uint64)).view(np.int64)
                yield pd.DataFrame(out)

    names = [f"{x}{n}" for n in range(1, ORDER + 1) for x in "gc"]
    got = rows.mapInPandas(count, "lang int, k long, " + ", ".join(f"{n} long" for n in names)).groupBy("lang", *names).agg(F.sum("k").alias("k")).toPandas()
    parts = []
    for n in range(ORDER, 0, -1):
        frame = pd.DataFrame({"lang": got["lang"], "n": n, "k": got["k"], "gram": got[f"g{n}"], "context": got[f"c{n}"], "shorter": got[f"g{n - 1}"] if n > 1 else 0})
        if n < ORDER:  # continuation counts: one for each distinct longer n-gram
            frame["longer"] = got[f"g{n + 1}"]
            frame = frame.drop_duplicates(["lang", "gram", "longer"])
            frame = frame.groupby(["lang", "n", "gram"], as_index=False).agg(k=("longer", "size"), context=("context", "first"), shorter=("shorter", "first"))
        parts.append(frame[["lang", "n", "k", "gram", "context", "shorter"]])
    out = pd.concat(parts)
    for c in ("gram", "context", "shorter"):
        out[c] = out[c].to_numpy(np.int64).view(np.uint64)
    return out


def sample(rows: DataFrame) -> DataFrame:
    """The training sample of (doc_id, text, lang): bounded in languages, rows and characters, whatever the table's size.

    Only ids and lengths are ranked, and of a large language only those of the smallest hashes.
    """
    whole = F.length("text")
    part = F.when(whole > LONGEST_SAMPLED, F.substring(F.col("text"), F.expr(f"cast((length(text) - {LONGEST_SAMPLED}) div 2 + 1 as int)"), F.lit(LONGEST_SAMPLED))).otherwise(F.col("text"))
    rows = rows.select("lang", "doc_id", part.alias("text"))
    hash_ = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62))
    # ids, not rows, are counted and ranked: a language whose rows repeat few ids is learnt from those
    known = rows.groupBy("lang", "doc_id").agg(F.max(F.length("text")).alias("size")).withColumn("h", hash_)
    common = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    share = F.least(F.lit(TRAINING_CHARS), F.floor(F.lit(TOTAL_CHARS) / F.count("*").over(W.partitionBy())))
    common = common.withColumn("share", share)  # at most LANGUAGES rows
    # hashes below a bound that about half as many again have: no language's ids all come together to be ranked
    bound = F.least(F.lit(1.0), 1.5 * TRAINING_ROWS / F.col("count")) * float(1 << 62)
    near = known.join(F.broadcast(common), "lang").where(F.col("h") < bound).drop("count")
    by = W.partitionBy("lang").orderBy("h", "doc_id")
    first = near.withColumn("n", F.row_number().over(by)).where(F.col("n") <= TRAINING_ROWS)
    before = F.coalesce(F.sum("size").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = first.withColumn("before", before).where(F.col("before") < F.col("share")).select("lang", "doc_id", "size")
    # at most LANGUAGES x TRAINING_ROWS short rows are sent; of an id's rows the longest text counts, equal ones once
    here = rows.join(F.broadcast(first), ["lang", "doc_id"]).where(F.length("text") == F.col("size"))
    return here.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", "lang")


def fit(docs: DataFrame, train) -> LanguageModels:
    """Models from a bounded ``sample`` of the rows of (doc_id, text, lang) for which ``train`` holds.

    Rows without text, language or id take no part.  Without any, every text is ``und``.  Sharpness and the
    rejection bound are set on the same sample.
    """
    rows = docs.select("doc_id", "text", "lang").where(train & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    chosen = materialise(sample(rows))  # read twice
    langs = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    if not langs:
        return LanguageModels([], np.zeros(0), [(np.zeros(0, np.uint64), np.zeros((0, 0)))] * ORDER, [(np.zeros(0, np.uint64), np.zeros((0, 0)))] * (ORDER - 1))
    spark = docs.sparkSession
    model = _kneser_ney(_count(chosen.select("text", "lang"), langs), langs)
    shared, number = spark.sparkContext.broadcast(model), {x: k for k, x in enumerate(langs)}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            entropy, chars = shared.value.cross_entropy(pdf["text"].tolist())
            out = pd.DataFrame(entropy, columns=[f"e{k}" for k in range(len(langs))])
            out["lang"], out["chars"] = pdf["lang"].map(number).to_numpy(np.int64), chars
            yield out

    got = chosen.select("text", "lang").mapInPandas(measure, ", ".join([f"e{k} double" for k in range(len(langs))] + ["lang long", "chars long"])).toPandas()
    got = got[got["chars"] > 0]
    entropy, own = got[[f"e{k}" for k in range(len(langs))]].to_numpy(), got["lang"].to_numpy()
    if len(got):
        gap = entropy - entropy.min(1, keepdims=True)
        loss = {s: float((s * gap[np.arange(len(own)), own] + np.log(np.exp(-s * gap).sum(1))).mean()) for s in (1, 2, 5, 10, 20, 50)}
        model.sharpness = min(loss, key=lambda s: (loss[s], s))
    # mixed texts fit no language well: the bound is one for all, beyond what the hardest language shows in training
    own_entropy = [entropy[own == k, k] for k in range(len(langs)) if (own == k).sum() >= 20]
    if own_entropy:
        model.worst = max(float(np.quantile(e, 0.99) + max(1.0, 6 * e.std())) for e in own_entropy) + 0.5
    return model


def _predictor(spark: SparkSession, model: LanguageModels):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        texts = text.tolist()
        parts = [shared.value.predict(texts[lo:hi]) for lo, hi in slices(texts)] or [shared.value.predict([])]
        return pd.DataFrame({c: np.concatenate([p[k] for p in parts]) for k, c in enumerate(("lang_pred", "score", "accepted"))})

    return predict


def trained(spark: SparkSession, sf_dir: str) -> LanguageModels:
    """Models of the documents outside the held-out fold (crc32 of the id mod 3 is 1)."""
    return fit(table(spark, sf_dir, "documents"), ~fold_is(F.col("doc_id"), 3, 1))


def identify(docs: DataFrame, model: LanguageModels) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted for every row; null and letterless texts are ``und``, score 0.

    Of languages that fit a text alike the first by name is predicted.  Repeated rows are predicted each, equal texts alike;
    an empty table gives no rows.
    """
    found = docs.select("doc_id", _predictor(docs.sparkSession, model)("text").alias("p"))
    return found.select("doc_id", fold_is(F.col("doc_id"), 3, 1).alias("held_out"), "p.lang_pred", "p.score", "p.accepted")


def drop_unidentified(docs: DataFrame, model: LanguageModels) -> DataFrame:
    """``docs`` without rows that no model accepts (no letters, or unlike every language); all columns stay, whatever their names.

    Repeated rows go or stay together; an empty table stays empty.
    """
    predict, name = _predictor(docs.sparkSession, model), unused(docs, "__language")
    return docs.withColumn(name, predict(F.col("text"))).where(F.col(name)["accepted"]).drop(name)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
