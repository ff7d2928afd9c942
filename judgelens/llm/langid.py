"""Language identification by a linear-chain conditional random field over words.

Every word of a text is labelled, so code-switched texts get a label per word. A word's emission
scores sum learned weights of its features: character n-grams with word boundaries (hashed),
prefixes and suffixes, and its entry in a lexicon of words frequent in the training texts. Learned
transitions couple neighbouring words; forward-backward gives each word's posterior. A text's
language is the label with the largest mean posterior.

Training fits the CRF likelihood on sequences spliced from texts of different languages, so the
transitions see switches. All array work is on whole chunks of text: no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelens.llm.common import batched, bounded_sample, text_rows

#: Texts sampled per language for training, and their words in all, at most.
DOCS_PER_LANG, TRAIN_WORDS = 120, 150_000
#: Hash buckets of the n-gram and affix features; words in the lexicon per language.
BUCKETS, LEXICON = 1 << 16, 2000
#: Words in a spliced training sequence; spans of this many words on average come from one text.
SEQUENCE, SPAN = 48, 12
EPOCHS, RATE, L2 = 25, 0.15, 1e-6
#: Characters that are scored at a time.
CHUNK = 1 << 18
UNDETERMINED = "und"


@dataclass
class Model:
    langs: list[str]
    letters: np.ndarray  # packed bits: which code points are letters
    table: np.ndarray  # (BUCKETS, K) weights of the hashed features
    lexicon: np.ndarray  # sorted word hashes
    lexicon_weights: np.ndarray  # (len(lexicon), K)
    transitions: np.ndarray  # (K, K)
    starts: np.ndarray  # (K,)


def letter_bits() -> np.ndarray:
    return np.packbits(np.array([chr(c).isalpha() for c in range(0x110000)], bool))


def features(codes: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The features of the words (runs of letters) of a stretch of text.

    Returns word starts and ends, two arrays of n-gram buckets with one entry per letter (bigrams
    and trigrams around it, word boundaries included), and an array (words, 4) of affix buckets
    and the words' hashes as the last item's column."""
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = letter[codes]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    # code points outside words count as one boundary sign
    c = np.zeros(len(codes) + 4, np.uint32)
    c[2:-2] = np.where(inside[1:-1] > 0, codes, 0)
    at = np.flatnonzero(inside[1:-1]) + 2
    mask = np.uint32(BUCKETS - 1)

    def bucket(seed: int, *parts: np.ndarray) -> np.ndarray:
        h = np.full(len(parts[0]), seed, np.uint32)
        for x in parts:
            h = (h ^ x) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        return h & mask

    bigrams = bucket(17, c[at], c[at + 1])
    trigrams = bucket(29, c[at - 1], c[at], c[at + 1])
    s, e = starts + 2, ends + 1  # first and last letter
    affixes = np.stack([bucket(41, c[s], c[s + 1]), bucket(43, c[s], c[s + 1], np.where(e - s >= 2, c[s + 2], 0).astype(np.uint32)),
                        bucket(47, c[e - 1], c[e]), bucket(53, np.where(e - s >= 2, c[e - 2], 0).astype(np.uint32), c[e - 1], c[e])], axis=1)
    # a word's hash: a polynomial in its letters, by prefix sums modulo 2^64
    m = 0x9E3779B97F4A7C15
    up, down = powers(m, len(codes)), powers(pow(m, -1, 1 << 64), len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1)) * up[:len(codes)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return starts, ends, np.stack([bigrams, trigrams]), affixes, hashes


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64."""
    a = np.full(n + 1, base, np.uint64)
    a[0] = 1
    return np.cumprod(a, dtype=np.uint64)


def emissions(model: Model, codes: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """(words, K) scores of the words of a stretch of text."""
    starts, ends, grams, affixes, hashes = features(codes, letter)
    if not len(starts):
        return np.zeros((0, len(model.langs)), np.float32)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    per_letter = model.table[grams[0]] + model.table[grams[1]]
    scores = np.add.reduceat(per_letter, first, axis=0) + model.table[affixes].sum(axis=1)
    if len(model.lexicon):
        k = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
        known = model.lexicon[k] == hashes
        scores[known] += model.lexicon_weights[k[known]]
    return scores


def posteriors(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Word posteriors (words, K) of texts laid end to end; ``first`` marks each text's first word.

    Forward-backward as a blocked scan: the chain is cut into blocks that advance together; the
    product of each block's transfer matrices carries the state from block to block."""
    t, k = scores.shape
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    width = max(1, int(np.sqrt(t)))
    blocks = -(-t // width)
    pad = blocks * width - t
    trans, begin = np.exp(transitions), np.exp(starts)
    # padding words emit the same for all labels and begin a new text, so they change nothing before them
    emit = np.concatenate([emit, np.ones((pad, k))]).reshape(blocks, width, k)
    fresh = np.concatenate([first, np.ones(pad, bool)]).reshape(blocks, width)

    def step(state: np.ndarray, i: int) -> np.ndarray:
        """One word further: state (blocks, rows, K)."""
        moved = state @ trans
        if fresh[:, i].any():
            moved = np.where(fresh[:, i, None, None], state.sum(axis=2, keepdims=True) * begin, moved)
        moved = moved * emit[:, i, None, :]
        return moved / np.maximum(moved.max(axis=(1, 2), keepdims=True), 1e-300)

    product = np.broadcast_to(np.eye(k), (blocks, k, k))
    for i in range(width):
        product = step(product, i)
    state = np.empty((blocks, 1, k))
    state[0] = 1.0 / k
    for b in range(1, blocks):
        nxt = state[b - 1] @ product[b - 1]
        state[b] = nxt / nxt.sum()
    alpha = np.empty_like(emit)
    for i in range(width):
        state = step(state, i)
        alpha[:, i] = state[:, 0]

    def step_back(state: np.ndarray, i: int) -> np.ndarray:
        """One word back: beta before word i from beta at word i; state (blocks, K, columns)."""
        weighted = emit[:, i, :, None] * state
        moved = trans @ weighted
        if fresh[:, i].any():
            moved = np.where(fresh[:, i, None, None], (begin[None, :, None] * weighted).sum(axis=1, keepdims=True), moved)
        return moved / np.maximum(moved.max(axis=(1, 2), keepdims=True), 1e-300)

    beta = np.empty_like(emit)
    after = np.empty((blocks, k, 1))
    after[-1] = 1.0
    for b in range(blocks - 1, 0, -1):
        nxt = product_back(product[b], after[b])
        after[b - 1] = nxt / nxt.sum()
    state = after
    for i in range(width - 1, -1, -1):
        beta[:, i] = state[:, :, 0]
        state = step_back(state, i)
    both = (alpha * beta).reshape(blocks * width, k)[:t]
    return both / np.maximum(both.sum(axis=1, keepdims=True), 1e-300)


def product_back(product: np.ndarray, after: np.ndarray) -> np.ndarray:
    return product @ after


def train(texts: list[tuple[str, str]], epochs: int = EPOCHS, train_words: int = TRAIN_WORDS, seed: int = 5) -> Model:
    """Fit the CRF to (text, language) pairs by full-batch Adam on the exact likelihood gradient."""
    langs = sorted({lang for _, lang in texts})
    k, rng = len(langs), np.random.RandomState(seed)
    bits = letter_bits()
    letter = np.unpackbits(bits).view(bool)
    owners, labels, grams, n_letters, affixes, hashes, total = [], [], [], [], [], [], 0
    for d in rng.permutation(len(texts)):
        text, lang = texts[d]
        starts, ends, g, a, h = features(np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32), letter)
        if not len(starts) or total >= train_words and lang in {langs[x[0]] for x in labels}:
            continue
        total += len(starts)
        owners.append(np.full(len(starts), d))
        labels.append(np.full(len(starts), langs.index(lang)))
        for out, value in ((grams, g), (n_letters, ends - starts), (affixes, a), (hashes, h)):
            out.append(value)
    empty = Model(langs, bits, np.zeros((BUCKETS, k), np.float32), np.zeros(0, np.uint64), np.zeros((0, k), np.float32), np.zeros((k, k)), np.zeros(k))
    if not labels or k < 2:
        return empty
    # the lexicon: the words most frequent in each language
    y, h = np.concatenate(labels), np.concatenate(hashes)
    lexicon: set[int] = set()
    for c in range(k):
        words, n = np.unique(h[y == c], return_counts=True)
        lexicon |= set(words[np.lexsort((words, -n))][:LEXICON][: max(1, int((n > 1).sum()))].tolist())
    lex = np.array(sorted(lexicon), np.uint64)
    # splice: spans of the texts in random order, so sequences switch language
    index = np.arange(len(y))
    spans = [s for block in np.split(index, np.cumsum([len(x) for x in labels])[:-1]) for s in np.array_split(block, max(1, len(block) // SPAN))]
    order = np.concatenate([spans[i] for i in rng.permutation(len(spans))])
    n_seq = max(1, len(order) // SEQUENCE)
    order = order[:n_seq * SEQUENCE] if len(order) >= SEQUENCE else order
    length = len(order) // n_seq
    # every word's features as one list of rows of a joint weight table
    lens = np.concatenate(n_letters)
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    letters_of = np.concatenate(grams, axis=1)
    slot = np.minimum(np.searchsorted(lex, h), max(0, len(lex) - 1))
    slot = np.where(lex[slot] == h, BUCKETS + slot, BUCKETS + len(lex))  # the last row stays zero
    reps = lens[order]
    pick = np.repeat(first[order] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(int(reps.sum()))
    word_of = np.repeat(np.arange(len(order)), reps)
    aff = np.concatenate(affixes)[order]
    row = np.concatenate([letters_of[0][pick], letters_of[1][pick], aff.ravel(), slot[order]]).astype(np.int64)
    word = np.concatenate([word_of, word_of, np.repeat(np.arange(len(order)), 4), np.arange(len(order))])
    by_word = np.argsort(word, kind="stable")
    row, word = row[by_word], word[by_word]
    edge = np.searchsorted(word, np.arange(len(order)))
    gold = y[order].reshape(n_seq, length)
    one = np.eye(k)[gold]
    w = np.zeros((BUCKETS + len(lex) + 1, k))
    tr, st = np.eye(k), np.zeros(k)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, tr, st)]
    for epoch in range(1, epochs + 1):
        scores = np.add.reduceat(w[row].astype(np.float32), edge, axis=0).reshape(n_seq, length, k)
        marg, pair = sequence_marginals(scores, tr, st)
        g_emit = (one - marg).reshape(-1, k)
        g_w = np.stack([np.bincount(row, g_emit[word, c], len(w)) for c in range(k)], axis=1) / len(order) - L2 * w
        g_w[-1] = 0
        seen = np.zeros((k, k))
        np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        g_tr = (seen - pair) / len(order)
        g_st = (one[:, 0] - marg[:, 0]).sum(axis=0) / len(order)
        for p, g, (m1, m2) in zip((w, tr, st), (g_w, g_tr, g_st), moments):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p += RATE * (m1 / (1 - 0.9**epoch)) / (np.sqrt(m2 / (1 - 0.99**epoch)) + 1e-8)
    return Model(langs, bits, w[:BUCKETS].astype(np.float32), lex, w[BUCKETS:BUCKETS + len(lex)].astype(np.float32), tr, st)


def sequence_marginals(scores: np.ndarray, transitions: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals (sequences, length, K) and expected transition counts (K, K), over equally long sequences."""
    n, length, k = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(np.float64)
    trans = np.exp(transitions)
    alpha, beta = np.empty((n, length, k)), np.ones((n, length, k))
    a = emit[:, 0] * np.exp(starts)
    for i in range(length):
        if i:
            a = (a @ trans) * emit[:, i]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[:, i] = a
    pair = np.zeros((k, k))
    for i in range(length - 1, 0, -1):
        ahead = emit[:, i] * beta[:, i]
        b = ahead @ trans.T
        # P(y[i-1], y[i]) in proportion to alpha * transition * ahead
        joint = alpha[:, i - 1, :, None] * trans[None] * ahead[:, None, :]
        pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[:, i - 1] = b / b.sum(axis=1, keepdims=True)
    marg = alpha * beta
    return marg / marg.sum(axis=2, keepdims=True), pair


def training_sample(docs: DataFrame, per_lang: int = DOCS_PER_LANG, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang") -> list[tuple[str, str]]:
    """(text, language) of at most ``per_lang`` texts for each language, whole, spread over all rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        "lang is not null and text is not null and id is not null")
    ids = bounded_sample(rows, "lang", "id", per_lang).select("id")
    # a few ids per language
    found = rows.join(F.broadcast(ids.distinct()), "id", "left_semi").select("id", "lang", "text").collect()
    return sorted({(r["text"], r["lang"]) for r in found})


def label_words(model: Model, texts: list[str]) -> list[np.ndarray]:
    """The posteriors (words, K) of each text."""
    letter = np.unpackbits(model.letters).view(bool)
    scores = [text_emissions(model, t, letter) for t in texts]
    lengths = [len(s) for s in scores]
    if not sum(lengths) or not model.langs:
        return scores
    everything = np.concatenate(scores)
    first = np.zeros(len(everything), bool)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    first[offsets[:-1][np.array(lengths) > 0]] = True
    return np.split(posteriors(everything, first, model.transitions, model.starts), offsets[1:-1])


def text_emissions(model: Model, text: str, letter: np.ndarray) -> np.ndarray:
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    if len(codes) <= CHUNK:
        return emissions(model, codes, letter)
    out, low = [], 0
    while low < len(codes):  # cut behind the last code point that is no letter; a longer word goes whole
        high = min(low + CHUNK, len(codes))
        if high < len(codes):
            gaps = np.flatnonzero(~letter[codes[low:high]])
            high = low + int(gaps[-1]) + 1 if len(gaps) else word_end(codes, letter, high)
        out.append(emissions(model, codes[low:high], letter))
        low = high
    return np.concatenate(out)


def word_end(codes: np.ndarray, letter: np.ndarray, at: int) -> int:
    """The place behind the word that reaches ``at``: that of the next code point that is no letter, or the end."""
    while at < len(codes):
        gaps = np.flatnonzero(~letter[codes[at:at + CHUNK]])
        if len(gaps):
            return at + int(gaps[0])
        at = min(at + CHUNK, len(codes))
    return at


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of each text: doc_id, lang_pred, score (mean posterior of that label, 0 to 1),
    n_words, switches (neighbouring words whose best labels differ).

    A null text, or one without a letter, is ``und`` with score 0; ties go to the first label in
    code point order. A model trained on one language predicts it for every text with a letter, one
    trained on none ``und``. A word of any length is one word. Each row is judged alone; an empty table gives no
    rows. Other columns are not read."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()), ("switches", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            for (doc_id, _), p in zip(held, label_words(model, [t for _, t in held])):
                if not len(p) or not model.langs:
                    yield doc_id, UNDETERMINED, 0.0, len(p), 0
                    continue
                mean, best = p.mean(axis=0), p.argmax(axis=1)
                yield doc_id, model.langs[int(mean.argmax())], float(min(1.0, mean.max())), len(p), int((best[1:] != best[:-1]).sum())

        def out():
            held, size = [], 0
            for doc_id, text in text_rows(batches, "doc_id", "text"):
                held.append((doc_id, text or ""))
                size += len(text or "")
                if size >= CHUNK:
                    yield from flush(held)
                    held, size = [], 0
            if held:
                yield from flush(held)

        yield from batched(out(), schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        scan, "doc_id long, lang_pred string, score double, n_words long, switches long")
