"""SentencePiece (BPE) encoding and decoding; giant documents by a parallel max-plus scan.

A text of up to ``chunk`` characters is encoded in one go.  A longer one is cut into chunks, wherever that falls.
What happens left of a cut matters right of it only through the piece that covers the last character before the
cut: that piece is the boundary state.  Each chunk gives a max-plus matrix from the states at its left end to
those at its right end; products of matrices, which are associative, tell the one state at each cut that lies on
a whole path; with it each chunk is then traced by itself.

For BPE the path weights are 0 for *compatible* neighbours and minus infinity for others.  Two pieces are
compatible if BPE of their joined text gives just them; a segmentation is the BPE one exactly if all its
neighbours are compatible, so there is one path, and the result equals that of encoding the whole text.
No piece has a space mark after another character, so every segmentation ends a piece before a mark that follows
one: inside a chunk, what lies between the first and last such place is encoded in one go.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import materialise, table

MARK = "▁"
CHUNK = 1 << 15
#: characters or ids that are in the library's hands at once
AT_ONCE = 1 << 18
SHORT_BATCH = 512


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _runs(items: list) -> Iterator[tuple[int, int]]:
    """Slices of the items of about ``AT_ONCE`` elements in all, and at most 1024 items."""
    lo, n = 0, 0
    for k, x in enumerate(items):
        if k > lo and (n + len(x) > AT_ONCE or k - lo >= 1024):
            yield lo, k
            lo, n = k, 0
        n += len(x)
    if lo < len(items):
        yield lo, len(items)


class Pieces:
    """A SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.sp
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.longest = max(map(len, self.score), default=1)
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("the model has pieces that run across spaces")
        self.bytes = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        self.known: dict[tuple[str, str], bool] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for lo, hi in _runs(texts):
            out += [np.array(x, np.int32) for x in self.sp.encode(texts[lo:hi], num_threads=1)]
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        out = []
        for lo, hi in _runs(ids):
            out += self.sp.decode([x.tolist() for x in ids[lo:hi]], num_threads=1)
        return out

    def gives_back(self, ids: list[np.ndarray], texts: list[str]) -> list[bool]:
        """Whether decoding gives each text back."""
        out = []
        for lo, hi in _runs(ids):
            out += [a == b for a, b in zip(self.decode(ids[lo:hi]), texts[lo:hi])]
        return out

    def says(self, ids: np.ndarray, text: str) -> bool:
        """Whether ids from the middle of a text decode to ``text``; a full stop in front keeps a leading space."""
        return self.sp.decode([self.id["."], *ids.tolist()]) == "." + text

    def merge(self, text: str) -> list[str]:
        """BPE of a short text in space marks: the best-scored adjacent pair is joined first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 1 << 17:
                self.known.clear()
            found = self.known[key] = self.merge(a + b) == [a, b]
        return found

    def starting(self, text: str, at: int) -> list[str]:
        """Pieces that the text has at a place: those of the vocabulary and the single character."""
        return [text[at : at + n] for n in range(1, min(self.longest, len(text) - at) + 1) if n == 1 or text[at : at + n] in self.score]

    def ids(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            i = self.id.get(p)
            out += [i] if i is not None else [self.bytes[f"<0x{b:02X}>"] for b in p.encode("utf-8", "replace")]
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


# --- one chunk: text of the whole document's marks from ``lo`` to ``hi`` with ``longest`` characters around ---------

START, END = ("", 0), ("", 0)


def covering(model: Pieces, text: str, cut: int) -> list[tuple[str, int]]:
    """Boundary states at ``cut``: pieces over the character before it, and how far they reach beyond it."""
    out = []
    for start in range(max(0, cut - model.longest), cut):
        out += [(p, start + len(p) - cut) for p in model.starting(text, start) if start + len(p) >= cut and (len(p) == 1 or model.merge(p) == [p])]
    return out


def _free(text: str, lo: int, hi: int) -> tuple[int, int] | None:
    """First and last place of [lo, hi] where every segmentation ends a piece."""
    first = next((i for i in range(max(1, lo), hi + 1) if i < len(text) and text[i] == MARK and text[i - 1] != MARK), None)
    if first is None:
        return None
    last = next(i for i in range(hi, first - 1, -1) if i < len(text) and text[i] == MARK and text[i - 1] != MARK)
    return first, last


def _spread(model: Pieces, text: str, live: dict[int, dict[str, int]], lo: int, hi: int) -> list[tuple[str, int, int]]:
    """Walk from the pieces that end at each place of ``live`` (with masks of where they came from) to ``hi``.

    Returns (piece, end, mask) of the pieces over the character before ``hi``.
    """
    done = [(p, e, m) for e, at in live.items() if e >= hi for p, m in at.items()]
    for i in range(lo, hi):
        here = live.pop(i, None)
        if not here:
            continue
        for b in model.starting(text, i):
            mask = 0
            for a, m in here.items():
                if not a or model.compatible(a, b):
                    mask |= m
            if mask:
                e = i + len(b)
                if e >= hi:
                    done.append((b, e, mask))
                else:
                    at = live.setdefault(e, {})
                    at[b] = at.get(b, 0) | mask
    return done


def transfer(model: Pieces, text: str, lo: int, hi: int, first: bool, last: bool) -> tuple[list, list, np.ndarray]:
    """States at the two ends of a chunk and the max-plus matrix between them."""
    entries = [START] if first else covering(model, text, lo)
    exits = [END] if last else covering(model, text, hi)
    matrix = np.full((len(entries), len(exits)), -np.inf)
    live: dict[int, dict[str, int]] = {}
    for k, (p, over) in enumerate(entries):
        at = live.setdefault(lo + over, {})
        at[p] = at.get(p, 0) | 1 << k
    free = _free(text, lo, hi)
    if free:
        reached = 0
        for _, e, m in _spread(model, text, live, lo, free[0]):
            reached |= m if e == free[0] else 0
        live = {free[1]: {"": reached}} if reached else {}
        ends = _spread(model, text, live, free[1], hi)
    else:
        ends = _spread(model, text, live, lo, hi)
    place = {(p, over): k for k, (p, over) in enumerate(exits)}
    for p, e, m in ends:
        col = (0 if e == hi else None) if last else place.get((p, e - hi))
        if p == "" and not last:  # the free place is the cut itself: any piece that ends there
            for k, (_, over) in enumerate(exits):
                if over == 0:
                    matrix[[r for r in range(len(entries)) if m >> r & 1], k] = 0
        elif col is not None:
            matrix[[r for r in range(len(entries)) if m >> r & 1], col] = 0
    return entries, exits, matrix


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), -np.inf)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by pairs: neighbours first, then the prefixes of their products."""
    if len(matrices) < 2:
        return list(matrices)
    paired = scan([product(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)])
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(paired[i // 2] if i % 2 else product(paired[i // 2 - 1], matrices[i]))
    return out


def boundary_states(chunks: list[tuple[list, list, np.ndarray]]) -> list[tuple[str, int]]:
    """The state at each inner cut that lies on a path from the start to the end."""
    ahead = scan([m for _, _, m in chunks])
    behind = [m.T for m in scan([m.T for _, _, m in reversed(chunks)])][::-1]
    out = []
    for k in range(len(chunks) - 1):
        score = ahead[k][0] + behind[k + 1][:, 0]
        # a piece on a whole path is found once; behind a free cut several pieces may look alike from the right
        out.append(chunks[k][1][int(score.argmax())])
    return out


def trace(model: Pieces, text: str, lo: int, hi: int, entry: tuple[str, int], exit_: tuple[str, int] | None) -> list[int]:
    """Ids of the pieces that start after ``entry``, up to and with the one that ``exit_`` names (None: to the end)."""
    start, want = lo + entry[1], None if exit_ is None else (exit_[0], hi + exit_[1])

    def between(a: str, i: int, j: int, last: tuple[str, int] | None) -> list[str]:
        """The pieces from ``i`` to ``j`` after ``a``: backwards through the pieces that can end at each place."""
        if i >= j and (last is None or last[1] <= i):
            return []
        back: dict[tuple[int, str], tuple[int, str]] = {}
        live = {i: [a]}
        target = None
        for k in range(i, j):
            for b in model.starting(text, k) if k in live else ():
                for x in live[k]:
                    if not x or model.compatible(x, b):
                        e = k + len(b)
                        if (e, b) not in back:
                            back[e, b] = (k, x)
                            live.setdefault(e, []).append(b)
                        break
        target = last and (last[1], last[0])
        if target is None:
            target = (j, next(b for b in live[j] if (j, b) in back))
        out = []
        while target[0] > i:
            out.append(target[1])
            k, x = back[target]
            target = (k, x)
        return out[::-1]

    free = _free(text, start, hi)
    if free is None:
        return model.ids(between(entry[0], start, hi, (want[0], want[1]) if want else None))
    f, g = free
    head = between(entry[0], start, f, None)
    middle = model.encode([text[f + 1 : g].replace(MARK, " ")])[0].tolist() if g > f else []
    tail = between("", g, hi, (want[0], want[1]) if want and want[1] > g else None) if g < hi else []
    return model.ids(head) + middle + model.ids(tail)


def split_text(text: str, size: int, around: int) -> Iterator[tuple[int, str, int, int, bool, bool]]:
    """Chunks of a text: number, its characters as space marks with ``around`` more on either side, where the chunk
    lies in them, and whether it is the first and the last."""
    whole = (MARK + text).replace(" ", MARK)
    cuts = [*range(0, len(whole), size), len(whole)]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < 2 * around:  # no piece may reach across a whole chunk
        del cuts[-2]
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        left = max(0, lo - around)
        yield k, whole[left : hi + around], lo - left, hi - left, lo == 0, hi == len(whole)


def encode_in_chunks(model: Pieces, text: str, size: int) -> list[int]:
    """The scan on one machine, as the operator spreads it over the cluster."""
    parts = list(split_text(text, size, model.longest))
    states = boundary_states([transfer(model, t, lo, hi, a, z) for _, t, lo, hi, a, z in parts]) if len(parts) > 1 else []
    ends = [START, *states, None]
    return [i for k, (_, t, lo, hi, _, _) in enumerate(parts) for i in trace(model, t, lo, hi, ends[k], ends[k + 1])]


# --- the operator ---------------------------------------------------------------------------------------------------


def _encode_giants(giants: DataFrame, path: str, size: int) -> DataFrame:
    """(key, ids, same) of the distinct (key, text) rows of ``giants``; ``same``: every chunk decodes to its text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces(path)
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"]):
                for part in split_text(text, size, model.longest):
                    yield pd.DataFrame([(key, *part)], columns=["key", "part", "chunk", "lo", "hi", "first", "last"])

    chunks = materialise(
        giants.mapInPandas(cut, "key string, part int, chunk string, lo int, hi int, first boolean, last boolean").repartition("key", "part")
    )

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces(path)
        for pdf in batches:
            found = [pickle.dumps(transfer(model, r.chunk, r.lo, r.hi, r.first, r.last)) for r in pdf.itertuples()]
            yield pd.DataFrame({"key": pdf["key"], "part": pdf["part"], "matrix": found})

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        states = boundary_states([pickle.loads(m) for m in pdf["matrix"]])
        rows = [(key, int(k), a, z) for key, k, a, z in zip(pdf["key"], pdf["part"], [START, *states], [*states, None])]
        return pd.DataFrame([(key, k, pickle.dumps((a, z))) for key, k, a, z in rows], columns=["key", "part", "ends"])

    # a group holds the small matrices of one document
    ends = chunks.mapInPandas(matrices, "key string, part int, matrix binary").groupBy("key").applyInPandas(combine, "key string, part int, ends binary")

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces(path)
        for pdf in batches:
            for r in pdf.itertuples():  # a chunk at a time
                entry, exit_ = pickle.loads(r.ends)
                ids = np.array(trace(model, r.chunk, r.lo, r.hi, entry, exit_), np.int32)
                span = r.chunk[r.lo + entry[1] : r.hi + (exit_[1] if exit_ else 0)]
                same = model.says(ids, span.replace(MARK, " "))
                yield pd.DataFrame({"key": pd.Series([r.key], dtype=object), "part": [r.part], "ids": [ids], "same": [same]})

    traced = chunks.join(ends, ["key", "part"]).mapInPandas(back, "key string, part int, ids array<int>, same boolean")
    return traced.groupBy("key").agg(F.bool_and("same").alias("same"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode_documents(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ``token_ids`` (array of int), ``n_tokens`` and ``round_trip`` (decoding gives the text back).

    Existing columns of these names are replaced.  A null text has null ids and a null round trip, an empty one
    no ids.  Repeated rows are each encoded.  Texts over ``chunk`` characters go through the parallel scan.
    """
    path = path or default_model()
    base = docs.drop("token_ids", "n_tokens", "round_trip")

    names, text_at = [*base.columns, "token_ids", "round_trip"], base.columns.index("text")
    schema = T.StructType([*base.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with ids and round trip, in short batches: ids stay in flat buffers, never as Python numbers."""
        model = pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SHORT_BATCH):
                part = batch.slice(at, SHORT_BATCH)
                texts = part.column(text_at).to_pylist()
                known = [k for k, t in enumerate(texts) if t is not None]
                found = model.encode([texts[k] for k in known])
                same = dict(zip(known, model.gives_back(found, [texts[k] for k in known])))
                ids = dict(zip(known, found))
                sizes = [len(ids[k]) if k in ids else 0 for k in range(len(texts))]
                flat = np.concatenate([np.zeros(0, np.int32), *found])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat), mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array([same.get(k) for k in range(len(texts))], pa.bool_())], names=names)

    short = F.coalesce(F.length("text") <= chunk, F.lit(True))
    done = base.where(short).mapInArrow(encode, schema)
    long_ = base.where(~short).withColumn("__key", F.sha2("text", 256))
    ids = _encode_giants(long_.select(F.col("__key").alias("key"), "text").dropDuplicates(["key"]), path, chunk)
    rest = long_.join(ids.select(F.col("key").alias("__giant"), F.col("ids").alias("token_ids"), F.col("same").alias("__same")), F.col("__key") == F.col("__giant"))
    both = done.unionByName(rest.withColumn("round_trip", F.col("__same") & ~F.col("text").contains(MARK)).drop("__key", "__giant", "__same"))
    return both.select(*base.columns, "token_ids", F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).cast("long").alias("n_tokens"), "round_trip")


def decode_documents(docs: DataFrame, path: str | None = None, ids: str = "token_ids") -> DataFrame:
    """``docs`` with ``decoded``, the text of the column ``ids``; null for null."""
    path = path or default_model()

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        known = rows.notna().to_numpy()
        found = iter(pieces(path).decode(rows[known].tolist()))
        return pd.Series([next(found) if k else None for k in known], dtype=object)

    return docs.withColumn("decoded", decode(ids))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
