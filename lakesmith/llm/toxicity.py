"""Toxicity by a support vector machine with a subsequence string kernel.

The kernel of two tokens sums, over all three-letter subsequences that span
at most ``SPAN`` letters, the products of their weights; an occurrence
weighs ``DECAY`` per letter it skips, so gapped and inserted characters cost
something but still match. Tokens are folded first: case, marks inside a
token, common digit-for-letter spellings, and runs of single letters, which
become one token.

Nyström landmarks (tokens of the training sentences) span the feature space
``k(x, Z) K_ZZ^(-1/2)``, and a squared-hinge SVM is trained in it. Only the
sentence carries a label, not its tokens: positive examples are at first
tokens that many toxic sentences and no clean one have, then also those of
toxic sentences that the model itself holds against them; all tokens of
clean sentences are negative ones. Positive examples come with spellings
that have a letter inserted. The
kernel's features are known, so landmarks and SVM fold into one weight per
subsequence: scoring a token is a table look-up for each of its
subsequences, with the same result as the kernel expansion.

A text's score is a logistic function, fitted on sentences that the SVM has
not seen, of its highest token value. The fit reads a bounded sample
of labelled rows (``SAMPLE`` toxic and ``CLEAN`` times as many clean ones,
those with the smallest hashes of their text); scoring reads every whole text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import IS_SPACE, chunks, text_bytes

SAMPLE = 900
CLEAN = 3           # clean training texts for each toxic one
LANDMARKS = 96
BLOCK = 8_192       # tokens whose features are worked on at once
HITS = 20_000       # occurrences of landmark subsequences that are summed at once
SPAN = 6
CAUTION = 60.0      # weight of all clean tokens against all positive examples
VARIANTS = 6        # misspellings of a positive example
DECAY = 0.5
REGULAR = 1e-4
OFTEN = 0.01        # share of the toxic training sentences (and no clean one) that makes a token a positive example
CUT = 0.3
CODES = 64
TABLE = CODES ** 3
FLOOR = -10.0       # value of a text without a token
_GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]      # places of the 2nd and 3rd letter after the 1st

_CODE = np.zeros(256, np.uint8)        # 0: dropped
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
for _mark, _letter in (("0", "o"), ("1", "i"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t"), ("@", "a"), ("$", "s")):
    _CODE[ord(_mark)] = ord(_letter) - 96
_CODE[128:192] = 27 + np.arange(64) % 36       # continuation bytes tell non-ASCII letters apart


def fold(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the letters, their token, and the row of each token."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    gap = IS_SPACE[b]
    start = np.zeros(len(b), bool)
    start[1:] = gap[:-1] | (row[1:] != row[:-1])
    word = np.cumsum(start)
    code = _CODE[b]
    keep = code > 0
    code, word, row = code[keep], word[keep], row[keep]
    if not len(code):
        return code, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.ones(len(code), bool)
    first[1:] = word[1:] != word[:-1]
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(code)))
    # a run of single letters is one token
    again = np.zeros(len(at), bool)
    again[1:] = (size[1:] == 1) & (size[:-1] == 1) & (row[at[1:]] == row[at[:-1]])
    at = at[~again]
    first[:] = False
    first[at] = True
    return code, np.cumsum(first, dtype=np.int32) - 1, row[at]


def subsequences(code: np.ndarray, token: np.ndarray):
    """(places, feature, weight) of the subsequences of tokens, gap by gap."""
    c = code.astype(np.int32)
    for i, j in _GAPS:
        if len(c) > j:
            inside = token[j:] == token[:-j]
            feature = (c[:-j] * CODES + c[i:len(c) - j + i]) * CODES + c[j:]
            yield inside, feature, DECAY ** (j - 2)


def scale(token: np.ndarray, n: int) -> np.ndarray:
    """Divisor of the kernel by token: the root of the summed squared
    weights of its subsequence occurrences, so long tokens have no larger
    values than short ones (1 for tokens without a subsequence)."""
    size = np.bincount(token, minlength=n)
    total = sum(np.maximum(size - j, 0) * DECAY ** (2 * (j - 2)) for _, j in _GAPS)
    return np.sqrt(np.where(total > 0, total, 1))


def whole_tokens(token: np.ndarray, block: int = 1 << 20):
    """Ranges of about ``block`` letters that end with a token."""
    i = 0
    while i < len(token):
        j = len(token) if i + block >= len(token) else int(np.searchsorted(token, token[i + block], "left"))
        j = j if j > i else int(np.searchsorted(token, token[i], "right"))
        yield i, j
        i = j


def token_values(code: np.ndarray, token: np.ndarray, n: int, weights: np.ndarray, bias: float) -> np.ndarray:
    """Decision value of every token."""
    total = np.zeros(len(code), np.float32)
    for inside, feature, decay in subsequences(code, token):
        total[:len(feature)] += np.where(inside, weights[feature], 0) * np.float32(decay)
    return np.bincount(token, total, minlength=n) / scale(token, n) + bias


def row_values(value: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """n x 1: the highest token value of every row."""
    out = np.full(n, FLOOR)
    np.maximum.at(out, row, value)
    return out[:, None]


# ---------------------------------------------------------------- training

def kernel_features(code: np.ndarray, token: np.ndarray, n: int, used: np.ndarray, table: np.ndarray) -> np.ndarray:
    """n x landmarks kernel values, from the landmarks' feature table."""
    out = np.zeros((n, table.shape[1]), np.float32)
    slot = np.zeros(TABLE, np.int32)
    slot[used] = np.arange(1, len(used) + 1)
    for inside, feature, decay in subsequences(code, token):
        s = np.where(inside, slot[feature], 0)
        hit = np.flatnonzero(s)
        for i in range(0, len(hit), HITS):
            part = hit[i:i + HITS]
            t = token[part]
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            out[t[first]] += np.add.reduceat(table[s[part] - 1] * np.float32(decay), first, axis=0)
    out /= scale(token, n)[:, None].astype(np.float32)
    return out


def landmark_table(code: np.ndarray, token: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The features that the n landmarks have, and features x landmarks:
    their weights, of unit length by landmark."""
    found = [(feature[inside], token[:len(feature)][inside], decay) for inside, feature, decay in subsequences(code, token)]
    used = np.unique(np.concatenate([np.zeros(0, np.int32), *(f for f, _, _ in found)]))
    table = np.zeros((len(used), n), np.float32)
    for feature, column, decay in found:
        np.add.at(table, (np.searchsorted(used, feature), column), np.float32(decay))
    norm = np.sqrt((table ** 2).sum(axis=0))
    return used, table / np.where(norm > 0, norm, 1)


def svm(parts: list[np.ndarray], pos: np.ndarray, neg: np.ndarray, regular: float = REGULAR) -> np.ndarray:
    """Squared-hinge linear SVM (last entry: bias) by Newton steps. Row i
    of the parts, one after another, is a positive example of weight
    ``pos[i]`` and a negative one of weight ``neg[i]``. Rows are taken block
    by block."""
    total = pos.sum() + neg.sum()
    w = np.zeros(parts[0].shape[1] + 1)
    ridge = np.full(len(w), regular)
    ridge[-1] = 1e-9
    best = np.inf
    for _ in range(25):
        loss, hess, grad, at = (ridge * w * w).sum(), np.diag(ridge), np.zeros(len(w)), 0
        for rows in (x[i:i + BLOCK] for x in parts for i in range(0, len(x), BLOCK)):
            part = np.ones((len(rows), len(w)))
            part[:, :-1] = rows
            value = part @ w
            for y, weight in ((1.0, pos[at:at + len(rows)]), (-1.0, neg[at:at + len(rows)])):
                on = (weight > 0) & (y * value < 1)
                xa = part[on] * (weight[on, None] / total)
                loss += (weight[on] / total * (1 - y * value[on]) ** 2).sum()
                hess += part[on].T @ xa
                grad += y * xa.sum(axis=0)
            at += len(rows)
        if loss > best * (1 - 1e-6):
            break
        best = loss
        w = np.linalg.solve(hess, grad)
    return w


def _hashes(code: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    """A hash of the letters of every token."""
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    power = np.multiply.accumulate(np.full(int(np.diff(np.append(first, len(code))).max()), np.uint64(0x9E3779B97F4A7C15)))
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i, j in whole_tokens(token):
            place = np.arange(i, j) - first[token[i:j]]
            np.add.at(total, token[i:j], (code[i:j].astype(np.uint64) + np.uint64(7)) * power[place])
    return total


def _letters(code: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the chosen ones of tokens of these sizes, and the place
    among the chosen ones of each letter's token."""
    begin, sizes = (np.cumsum(size) - size)[chosen], size[chosen]
    place = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return code[place], np.repeat(np.arange(len(chosen)), sizes)


def _distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all distinct tokens, in the order of their hashes, and
    their sizes; the distinct token and the text of every token. Texts are
    folded chunk by chunk; of each, only letters of distinct tokens stay."""
    b, off = text_bytes(pa.array(texts, pa.string()))
    known, codes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    which, rows, n = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
    for i, j in chunks(off):
        code, token, row = fold(b[off[i]:off[j]], off[i:j + 1] - off[i])
        if not len(row):
            continue
        own, at, inv = np.unique(_hashes(code, token, len(row)), return_index=True, return_inverse=True)
        size = np.bincount(token, minlength=len(row))
        known.append(own)
        codes.append(_letters(code, size, at)[0])
        sizes.append(size[at])
        which.append((inv + n).astype(np.int32))
        rows.append((row + i).astype(np.int32))
        n += len(own)
    _, at, inv = np.unique(np.concatenate(known), return_index=True, return_inverse=True)
    size = np.concatenate(sizes)
    return _letters(np.concatenate(codes), size, at)[0], size[at], inv.astype(np.int32)[np.concatenate(which)], np.concatenate(rows)


def train(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS) -> dict:
    """Folded model: weights (TABLE), bias, and the logistic's coefficients."""
    rng = np.random.default_rng(5)
    fitted = np.arange(len(texts)) % 4 != 3        # a quarter is left for the logistic
    code, size, inv, row = _distinct(texts)
    use = fitted[row]
    if not use.any():
        return {"weights": np.zeros(TABLE, np.float32).tobytes(), "bias": FLOOR, "logistic": [0.0, 0.0]}
    pair = np.unique(inv[use].astype(np.int64) * len(texts) + row[use])          # a token once per sentence
    d, r = pair // len(texts), pair % len(texts)
    del pair, use
    pos = np.bincount(d, toxic[r], minlength=len(size))
    neg = np.bincount(d, ~toxic[r], minlength=len(size))
    n_pos, n_neg = max(1, toxic[fitted].sum()), max(1, (~toxic[fitted]).sum())
    odds = np.log((pos + 0.5) / n_pos) - np.log((neg + 0.5) / n_neg)
    present = np.flatnonzero(pos + neg)
    strong = present[np.argsort(-(odds * np.sqrt(pos))[present], kind="stable")][:landmarks * 3 // 4]
    rest = np.setdiff1d(present, strong)
    chosen = np.concatenate([strong, rng.permutation(rest)[:landmarks - len(strong)]])
    used, table = landmark_table(*_letters(code, size, chosen), len(chosen))
    gram = table.T @ table
    val, vec = np.linalg.eigh(gram.astype(np.float64))
    ok = val > 1e-6 * val.max()
    root = ((vec[:, ok] / np.sqrt(val[ok])) @ vec[:, ok].T).astype(np.float32)

    # the distinct tokens as a small corpus of their own
    x = np.empty((len(present), root.shape[1]), np.float32)
    for i in range(0, len(present), BLOCK):
        some = present[i:i + BLOCK]
        x[i:i + BLOCK] = kernel_features(*_letters(code, size, some), len(some), used, table) @ root
    p, q = pos[present], neg[present]

    def fit(p, q, extra=x[:0], times=np.zeros(0)):
        some = p.sum() + times.sum()
        return svm([x, extra], np.append(p, times) / some, np.append(CAUTION * q / max(1, q.sum()), np.zeros(len(extra))))

    often = (q == 0) & (p >= max(2, OFTEN * n_pos))
    if not often.any():
        often = odds[present] >= odds[present].max()
    w = fit(p * often, q)
    slot = np.full(len(size), -1)
    slot[present] = np.arange(len(present))
    mine = toxic[r] & (q[slot[d]] == 0)
    dd = slot[d[mine]]
    for _ in range(2):
        value = np.concatenate([x[i:i + BLOCK] @ w[:-1] for i in range(0, len(x), BLOCK)]) + w[-1]
        hold = (value[dd] > 0) | often[dd]
        held = np.bincount(dd[hold], minlength=len(present)).astype(float)
        if not held.any():
            break
        letters, word = _letters(code, size, present[held > 0])
        words = np.split(letters, np.flatnonzero(np.diff(word)) + 1)
        noisy, times = _with_insertions(words, held[held > 0], rng)
        extra = kernel_features(np.concatenate(noisy), np.repeat(np.arange(len(noisy)), [len(v) for v in noisy]),
                                len(noisy), used, table) @ root
        w = fit(held, q, extra, times)
    weights = np.zeros(TABLE, np.float32)
    weights[used] = table @ (root @ w[:-1])
    bias = float(w[-1])
    token = np.repeat(np.arange(len(size), dtype=np.int32), size)
    value = np.concatenate([token_values(code[i:j], token[i:j] - token[i], int(token[j - 1] - token[i]) + 1, weights, bias)
                            for i, j in whole_tokens(token)])
    feats = row_values(value[inv], row, len(texts))
    logistic = _logistic(feats[~fitted], toxic[~fitted].astype(float))
    return {"weights": weights.tobytes(), "bias": bias, "logistic": logistic.tolist()}


def _with_insertions(words: list[np.ndarray], times: np.ndarray, rng: np.random.Generator) -> tuple[list, np.ndarray]:
    """Spellings of the words with one letter inserted, ``VARIANTS`` of each
    word of four letters or more, and their weights."""
    out, weight = [np.zeros(0, np.uint8)], [0.0]
    for word, n in zip(words, times.tolist(), strict=True):
        if len(word) < 4:
            continue
        for at in rng.integers(1, len(word), VARIANTS).tolist():
            out.append(np.insert(word, at, rng.integers(1, 27)).astype(np.uint8))
            weight.append(n / VARIANTS)
    return out, np.array(weight)


def _logistic(feats: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    x = np.concatenate([feats, np.ones((len(feats), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _train_rows(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["h", "text"], kind="stable")
    model = train(rows["text"].tolist(), rows["toxic"].to_numpy(bool))
    return pd.DataFrame({"weights": [model["weights"]], "bias": [model["bias"]], "logistic": [model["logistic"]]})


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        sample: int = SAMPLE) -> dict | None:
    """Fit on rows of ``docs`` (key, text) that ``labels`` (key, label) mark
    0 or 1, at most ``sample`` toxic and ``CLEAN * sample`` clean ones (in
    one task; the sample bounds it). The sample is chosen from the keys
    alone; only its texts move. None if a class is missing."""
    marks = (labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("toxic"))
             .join(docs.where(F.col(text).isNotNull()).select(key), key))
    parts = []
    for value, most in ((1, sample), (0, CLEAN * sample)):
        one = marks.where(F.col("toxic") == value).orderBy(F.xxhash64(key), key).limit(most)
        parts.append(one.select(key, (F.col("toxic") == 1).alias("toxic")))
    chosen = parts[0].unionByName(parts[1]).collect()       # at most (1 + CLEAN) * sample keys
    if len({r["toxic"] for r in chosen}) < 2:
        return None
    few = docs.sparkSession.createDataFrame(chosen, parts[0].schema).dropDuplicates([key])
    rows = (docs.join(F.broadcast(few), key).where(F.col(text).isNotNull())
            .select(F.col(text).alias("text"), "toxic", F.xxhash64(text).alias("h")).orderBy("h", "text").limit((1 + CLEAN) * sample))
    got = rows.groupBy(F.lit(0).alias("one")).applyInPandas(
        _train_rows, "weights binary, bias double, logistic array<double>").first()
    return {"weights": bytes(got["weights"]), "bias": got["bias"], "logistic": list(got["logistic"])}


def _scores(model: dict | None, with_text: bool = False):
    def run(batches):
        weights = np.frombuffer(model["weights"], np.float32) if model else None
        for batch in batches:
            b, off = text_bytes(batch.column("text"))
            for i, j in chunks(off):        # a small batch for each, so that no side holds all texts of a large one again
                score = np.zeros(j - i)
                if model:
                    w = np.array(model["logistic"])
                    code, token, row = fold(b[off[i]:off[j]], off[i:j + 1] - off[i])
                    value = token_values(code, token, len(row), weights, model["bias"])
                    x = row_values(value, row, j - i) @ w[:-1] + w[-1]
                    score = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
                part = batch.slice(i, j - i)
                columns = {"row": part.column("row"), **({"text": part.column("text")} if with_text else {}), "score": pa.array(score)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return run


def score(df: DataFrame, model: dict | None, keep: list[str | Column], text: str = "text",
          with_text: bool = False) -> DataFrame:
    """Columns ``keep`` of ``df``, its text as ``text`` if asked for (it
    travels once), and score (0 to 1, higher: likelier toxic). Null texts, and texts without a letter, get the score of a text
    whose tokens say nothing; without a model every score is 0. Equal texts
    get equal scores; an empty table gives an empty one."""
    cols = [F.col(f"`{c}`") if isinstance(c, str) else c for c in keep]
    base = df.select(F.struct(*cols).alias("row"), F.col(f"`{text}`").alias("text"))
    kept = [base.schema["row"], *[StructField("text", StringType())] * with_text]
    out = base.mapInArrow(_scores(model, with_text), StructType([*kept, StructField("score", DoubleType())]))
    return out.select("row.*", *["text"] * with_text, "score")
