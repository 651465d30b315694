"""Sentences that translate each other in bilingual batches (problem 4).

Translation tables are learned from pairs of rows by expectation maximisation (each word of one side is explained by the
words of the other). A sentence becomes a weighted bag of the words of the other side that its own words may become;
numbers and the sound of names belong to it as well. Bags are looked up in an inverted index of the batch's sentences in
both directions, matches that are best both ways are kept, and sentences left over join the match of a neighbour whose
counterpart holds their translation too.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from granthika.session import settle

from .sentences import BoundaryModel, learn_boundaries, sentence_spans

_TOKEN = re.compile(r"\d+(?:[.,/-]\d+)*|[^\W\d_](?:[^\W\d_]|[̀-ͯऀ-ःऺ-ॏ॑-ॗॢॣঁ-෿‌‍'’])*")
# How the letters of the scripts of India sound, by the last word of their Unicode names, where the name's own
# letters don't say it.
_SOUNDS = {
    "AA": "a", "II": "i", "UU": "u", "EE": "e", "OO": "o", "AI": "ai", "AU": "au", "R": "r", "RR": "r", "CANDRA": "o",
    "TTA": "t", "TTHA": "t", "THA": "t", "DDA": "d", "DDHA": "d", "DHA": "d", "NNA": "n", "NNNA": "n", "NYA": "n", "NGA": "n",
    "LLA": "l", "LLLA": "l", "RRA": "r", "SHA": "s", "SSA": "s", "KHA": "k", "GHA": "g", "CHA": "c", "JHA": "j", "PHA": "p", "BHA": "b",
}
_KEYS: dict[str, str] = {}
_TOKENS: dict[str, str] = {}
_LETTERS: dict[str, tuple[str, str]] = {}


def _letter(char: str) -> tuple[str, str]:
    """Kind of a character (consonant, vowel, sign, virama, other) and its sound."""
    got = _LETTERS.get(char)
    if got is None:
        name = unicodedata.name(char, "")
        last = name.rpartition(" ")[2]
        if "VOWEL SIGN" in name:
            got = ("sign", _SOUNDS.get(last, last.lower()))
        elif last == "VIRAMA" or name.endswith("SIGN VIRAMA") or "PULLI" in name:
            got = ("virama", "")
        elif " LETTER " in name and not name.startswith("LATIN"):
            vowel = last in ("A", "AA", "I", "II", "U", "UU", "E", "EE", "O", "OO", "AI", "AU")
            got = ("vowel", _SOUNDS.get(last, last.lower())) if vowel else ("consonant", _SOUNDS.get(last, last.lower().rstrip("a")))
        else:
            got = ("other", "")
        _LETTERS[char] = got
    return got


def sound(word: str) -> str:
    """A rough spelling of how a word sounds, the same for a name in Latin letters and in a script of India."""
    got = _KEYS.get(word)
    if got is not None:
        return got
    if word.isascii():
        key = re.sub(r"(.)\1+", r"\1", re.sub(r"([kgcjtdpbs])h", r"\1", word.lower()).replace("w", "v"))
    else:
        out, open_ = [], False
        for c in word:
            kind, say = _letter(c)
            if open_ and kind not in ("sign", "virama"):
                out.append("a")
            open_ = kind == "consonant"
            out.append(say)
        if open_:
            out.append("a")
        key = re.sub(r"(.)\1+", r"\1", "".join(out))
    if len(_KEYS) > 500_000:
        _KEYS.clear()
    _KEYS[word] = key
    return key


def tokens_of(text: str) -> list[str]:
    """Words in lower case, numbers in Western digits marked '#', capitalised words also as '^' and their sound."""
    if len(_TOKENS) >= 500_000:
        _TOKENS.clear()
    found = _TOKEN.findall(text)
    for w in set(found).difference(_TOKENS):
        if w[0].isdigit():
            _TOKENS[w] = "#" + "".join(str(unicodedata.digit(c)) if c.isdigit() else c for c in w)
        else:
            _TOKENS[w] = "^" + w if w[0].isupper() else w.replace("‌", "").replace("‍", "")
    return [_TOKENS[w] for w in found]


def word_sets(source: str, target: str) -> tuple[str, list[str], list[str]] | None:
    """The script of the target, and the words of both sides that a translation table learns from; None where a side has none."""
    s = {w.lower().lstrip("^") for w in tokens_of(source) if w[0] != "#"}
    t = {w for w in tokens_of(target) if w[0] not in "#^"}
    if not s or not t:
        return None
    script = Counter(unicodedata.name(w[0], "x").split(" ")[0] for w in sorted(t)).most_common(1)[0][0]
    return None if script == "LATIN" else (script, sorted(s), sorted(t))


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [x for pair in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (x := word_sets(*pair)) is not None]
        words = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), words, words))], ["script", "s", "t"])


def _weight(total: int, count: int) -> float:
    return max(0.05, math.log(total / (count + 1)))


def expected_counts(pairs: list[tuple[list[str], list[str]]], known_s, known_t, rounds: int) -> Iterator[tuple]:
    """Expectation maximisation over pairs of word sets, in both directions.

    Of each direction: whether it is forward, the words of both sides, and for each pair of words their numbers and how often the one
    is expected to become the other.
    """
    ids_s: dict[str, int] = {}
    ids_t: dict[str, int] = {}
    link_s, link_t, sizes = [], [], []
    for one_s, one_t in pairs:
        a = [ids_s.setdefault(w, len(ids_s)) for w in one_s if w in known_s]
        b = [ids_t.setdefault(w, len(ids_t)) for w in one_t if w in known_t]
        if a and b:
            link_s.append(np.tile(a, len(b)))
            link_t.append(np.repeat(b, len(a)))
            sizes.append((len(a), len(b)))
    if not sizes:
        return
    s, t = np.concatenate(link_s), np.concatenate(link_t)
    words_s, words_t = list(ids_s), list(ids_t)
    pair, at = np.unique(s * len(words_t) + t, return_inverse=True)
    at = at.astype(np.int32)
    del s, t, link_s, link_t
    p_s, p_t = pair // len(words_t), pair % len(words_t)
    slot_t = np.concatenate([np.repeat(np.arange(b, dtype=np.int32), a) for a, b in sizes]) + np.repeat(np.cumsum([0] + [b for _, b in sizes[:-1]]).astype(np.int32), [a * b for a, b in sizes])
    slot_s = np.concatenate([np.tile(np.arange(a, dtype=np.int32), b) for a, b in sizes]) + np.repeat(np.cumsum([0] + [a for a, _ in sizes[:-1]]).astype(np.int32), [a * b for a, b in sizes])
    for forward, slot, owner, to, names_from, names_to in ((True, slot_t, p_s, p_t, words_s, words_t), (False, slot_s, p_t, p_s, words_t, words_s)):
        prob = np.ones(len(pair))
        for _ in range(rounds):
            norm = np.bincount(owner, prob)[owner]
            prob = prob / np.maximum(norm, 1e-12)
            share = prob[at]
            share = share / np.bincount(slot, share)[slot]
            prob = np.bincount(at, share, len(pair))
        yield forward, names_from, names_to, owner, to, prob


def _expect(known_s, known_t, rounds: int, part: int, links: int = 6_000_000, least: float = 0.002):
    """``expected_counts`` over rows (script, s, t) in order of script, so many at a time.

    Pairs that are less than ``least`` of their word in a part are added up as one with the empty word: the word's total stays what it is, and
    a pair that is chosen in the end is above ten times that.
    """
    known_s, known_t = frozenset(known_s), frozenset(known_t)

    def flush(script: str, pairs: list) -> Iterator[pa.RecordBatch]:
        for forward, names_from, names_to, owner, to, count in expected_counts(pairs, known_s, known_t, rounds):
            whole = np.bincount(owner, count)
            at = np.flatnonzero(count >= least * whole[owner])
            rest = whole - np.bincount(owner[at], count[at], len(whole))
            left = np.flatnonzero(rest > 1e-9)
            word = pa.array(names_from).take(pa.array(np.concatenate([owner[at], left])))
            other = pa.array([*names_to, ""]).take(pa.array(np.concatenate([to[at], np.full(len(left), len(names_to))])))
            expected = pa.array(np.concatenate([count[at], rest[left]]))
            for k in range(0, len(expected), 50_000):
                n = min(50_000, len(expected) - k)
                yield pa.RecordBatch.from_arrays([pa.array([forward] * n), pa.array([script] * n), word.slice(k, n), other.slice(k, n), expected.slice(k, n)], ["forward", "script", "word", "other", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, of, size = [], None, 0
        for batch in batches:
            for script, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pairs and (script != of or len(pairs) >= part or size > links):
                    yield from flush(of, pairs)
                    pairs, size = [], 0
                of = script
                pairs.append((s, t))
                size += len(s) * len(t)
        if pairs:
            yield from flush(of, pairs)

    return run


class TranslationTable:
    """``forward[s]``: what word s may become and how well that fits, 1 being its best; ``backward`` the other way round."""

    def __init__(self) -> None:
        self.forward: dict[str, list[tuple[str, float]]] = {}
        self.backward: dict[str, list[tuple[str, float]]] = {}
        self.weight: dict[str, float] = {}
        self._clear()

    def _clear(self) -> None:
        self._entries: dict[tuple[str, str], tuple[float, dict[str, float]] | None] = {}
        self._found_by: dict[str, tuple[str, ...]] = {}

    def __getstate__(self):
        return {"forward": self.forward, "backward": self.backward, "weight": self.weight}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._clear()

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], *, rounds: int = 6, least: int = 4, keep: int = 12, fit: float = 0.12) -> TranslationTable:
        """Learn from (source, target) texts. Target words of each script are explained apart, so every language has its best words."""
        self = cls()
        by_script: dict[str, list[tuple[list[str], list[str]]]] = defaultdict(list)
        n_s, n_t = Counter(), Counter()
        for source, target in rows:
            found = word_sets(source, target)
            if found is not None:
                script, s, t = found
                n_s.update(s)
                n_t.update(t)
                by_script[script].append((s, t))
        total = sum(map(len, by_script.values())) or 1
        self.weight = {w: _weight(total, c) for counter in (n_t, n_s) for w, c in counter.items()}
        known_s, known_t = ({w for w, c in n.items() if c >= least} for n in (n_s, n_t))
        for pairs in by_script.values():
            for forward, names_from, names_to, owner, to, count in expected_counts(pairs, known_s, known_t, rounds):
                prob = count / np.maximum(np.bincount(owner, count)[owner], 1e-12)
                best = np.zeros(owner.max() + 1)
                np.maximum.at(best, owner, prob)
                rel = prob / best[owner]
                good = np.flatnonzero((rel >= fit) & (prob >= 0.02))
                lists: dict[int, list[tuple[float, int]]] = defaultdict(list)
                for k in good.tolist():
                    lists[int(owner[k])].append((float(rel[k]), int(to[k])))
                table = self.forward if forward else self.backward
                for k, options in lists.items():
                    table.setdefault(names_from[k], []).extend((names_to[x], r) for r, x in sorted(options, reverse=True)[:keep])
        return self._seen_from_both(keep)

    @classmethod
    def learn(cls, rows: DataFrame, *, rounds: int = 6, least: int = 4, keep: int = 12, fit: float = 0.12, part: int = 8_000) -> TranslationTable:
        """``fit`` over all ``rows`` (source, target).

        Words are counted over all rows; expectation maximisation runs side by side over parts of ``part`` rows chosen by hash, and the
        numbers of links that each part expects are added up. What a word may become is chosen from these sums, so the driver gets at most
        ``keep`` words for each word and script.
        """
        self = cls()
        pairs = rows.toDF("source", "target").where("source is not null and target is not null")
        sets = settle(pairs.mapInArrow(_word_sets, "script string, s array<string>, t array<string>"), "align-words")
        total = sets.count()
        counts = sets.select(F.explode("s").alias("w"), F.lit(True).alias("own")).unionByName(sets.select(F.explode("t").alias("w"), F.lit(False).alias("own")))
        counted = counts.groupBy("own", "w").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()
        known_s, known_t = {r.w: r.n for r in counted if r.own}, {r.w: r.n for r in counted if not r.own}
        dealt = sets.repartition(-(-total // part) or 1, F.xxhash64("s", "t")).sortWithinPartitions("script", F.xxhash64("s", "t"))
        links = dealt.mapInArrow(_expect(known_s.keys(), known_t.keys(), rounds, part), "forward boolean, script string, word string, other string, n double")
        sums = links.groupBy("forward", "script", "word", "other").agg(F.sum("n").alias("n"))
        own = Window.partitionBy("forward", "script", "word")
        prob, rel = F.col("n") / F.sum("n").over(own), F.col("n") / F.max(F.when(F.col("other") != "", F.col("n"))).over(own)
        good = sums.withColumns({"prob": prob, "rel": rel}).where("other <> ''").where((F.col("rel") >= fit) & (F.col("prob") >= 0.02))
        best = good.withColumn("k", F.row_number().over(own.orderBy(F.desc("rel"), F.desc("other")))).where(F.col("k") <= keep)
        for r in best.orderBy("forward", "word", "script", "k").select("forward", "word", "other", "rel").toArrow().to_pylist():
            (self.forward if r["forward"] else self.backward).setdefault(r["word"], []).append((r["other"], r["rel"]))
        # a word below ``least`` has no entry, so its weight is never asked for
        self.weight = {w: _weight(total, c) for counter in (known_t, known_s) for w, c in counter.items()}
        return self._seen_from_both(keep)

    def _seen_from_both(self, keep: int) -> TranslationTable:
        # a word that one language in a few rows has for s is seen from its own side: s is what explains it best
        for table, other in ((self.forward, {k: list(v) for k, v in self.backward.items()}), (self.backward, {k: list(v) for k, v in self.forward.items()})):
            more: dict[str, list[tuple[float, str]]] = defaultdict(list)
            for word, options in other.items():
                for back, rel in options:
                    if rel >= 0.6:
                        more[back].append((rel, word))
            for word, found in more.items():
                have = {x for x, _ in table.get(word, ())}
                table.setdefault(word, []).extend((x, 0.9 * rel) for rel, x in sorted(found, reverse=True)[: 4 * keep] if x not in have)
        return self

    def _entry(self, w: str, side: str) -> tuple[float, dict[str, float]] | None:
        """The weight of a word and what stands for it on the other side; looked up for words met before."""
        got = self._entries.get((w, side), False)
        if got is False:
            if len(self._entries) >= 400_000:
                self._entries.clear()
            got = self._entries[w, side] = self._anchor(w) if side == "names" else self._stands_for(w, self.forward if side == "forward" else self.backward)
        return got

    def _stands_for(self, w: str, table: dict[str, list[tuple[str, float]]]) -> tuple[float, dict[str, float]] | None:
        if w[0] == "#":
            return 5.0, {w: 1.0}
        word = w.lstrip("^").lower()
        options = table.get(word)
        if options is not None and (w[0] != "^" or self.weight.get(word, 9.0) < 6.0):
            weight = min(self.weight.get(word, 3.0), 5.0)
            return (weight, _best([*options, ("~" + sound(word), 1.0)])) if weight > 0.3 else None
        return (5.0 if w[0] == "^" else 2.5, {"~" + sound(word): 1.0}) if len(word) > 1 else None

    def _anchor(self, w: str) -> tuple[float, dict[str, float]]:
        word = w[1:].lower()
        return 1.0, {w: 1.0} if w[0] == "#" else _best([*self.forward.get(word, ()), ("~" + sound(word), 1.0)])

    def bag(self, tokens: list[str], forward: bool) -> list[tuple[float, dict[str, float]]]:
        """For each word of a sentence its weight and the words of the other side, or sounds, that stand for it."""
        side = "forward" if forward else "backward"
        return [e for w in dict.fromkeys(tokens) if (e := self._entry(w, side)) is not None]

    def anchors(self, tokens: list[str]) -> list[tuple[float, dict[str, float]]]:
        """The bag of a source sentence's numbers and names alone; a first word that has translations is no name."""
        return [self._entry(w, "names") for k, w in enumerate(tokens) if w[0] == "#" or w[0] == "^" and len(w) > 2 and (k or w[1:].lower() not in self.forward)]

    def index_tokens(self, tokens: list[str]) -> set[str]:
        """What a sentence is found by: its words, numbers and sounds."""
        known, out = self._found_by, set()
        for w in tokens:
            got = known.get(w)
            if got is None:
                if len(known) >= 400_000:
                    known.clear()
                word = w.lstrip("^").lower()
                got = known[w] = (w,) if w[0] == "#" else (word, "~" + sound(word)) if len(word) > 1 else (word,)
            out.update(got)
        return out


def _best(options: list[tuple[str, float]]) -> dict[str, float]:
    out: dict[str, float] = {}
    for word, fit in options:
        if fit > out.get(word, 0.0):
            out[word] = fit
    return out


class Inverted:
    """The sentences, by number, that each word, number or sound stands in."""

    def __init__(self, indexed: list[set[str]]) -> None:
        self.size = len(indexed)
        self.at: dict[str, int] = {}
        words, owners = [], []
        for j, found in enumerate(indexed):
            words += [self.at.setdefault(w, len(self.at)) for w in found]
            owners += [j] * len(found)
        words = np.array(words, np.int64)
        order = np.argsort(words, kind="stable")
        self.sentences = np.array(owners, np.int64)[order]
        self.counts = np.bincount(words, minlength=len(self.at))
        self.begins = np.cumsum(self.counts) - self.counts


def cover_all(bags: list, index: Inverted) -> np.ndarray:
    """(bags, sentences): the share of each bag's weight that a sentence of the other side holds, by an inverted index."""
    number: dict[int, int] = {}  # a word is looked up once for all sentences of the batch
    owner, entry, hit_entry, hit_word, hit_fit, weights = [], [], [], [], [], []
    at, keys = index.at, index.at.keys()
    for i, bag in enumerate(bags):
        for e in bag:
            k = number.get(id(e))
            if k is None:
                k = number[id(e)] = len(number)
                weights.append(e[0])
                options = e[1]
                for word in options.keys() & keys:
                    hit_entry.append(k)
                    hit_word.append(at[word])
                    hit_fit.append(options[word])
            owner.append(i)
            entry.append(k)
    if not hit_entry:
        return np.zeros((len(bags), index.size))
    share = np.zeros((len(bags), len(number)))
    np.add.at(share, (owner, entry), np.array(weights)[entry])
    share /= np.maximum(share.sum(1, keepdims=True), 1e-12)
    hit_word = np.array(hit_word)
    counts = index.counts[hit_word]
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    found = index.sentences[np.repeat(index.begins[hit_word], counts) + within]
    best = np.zeros((len(number), index.size))
    np.maximum.at(best, (np.repeat(hit_entry, counts), found), np.repeat(hit_fit, counts))
    return share @ best


def match(sources: list[tuple[int, str]], targets: list[tuple[int, str]], table: TranslationTable, *, pair_at: float = 0.45, grow_at: float = 0.62) -> list[tuple[int, int]]:
    """Pairs (source, target) of indexes; each sentence comes as (row, text)."""
    s_tokens, t_tokens = [tokens_of(x) for _, x in sources], [tokens_of(x) for _, x in targets]
    by_source, by_target = (Inverted([table.index_tokens(x) for x in tokens]) for tokens in (s_tokens, t_tokens))
    forward = cover_all([table.bag(x, True) for x in s_tokens], by_target)
    backward = cover_all([table.bag(x, False) for x in t_tokens], by_source).T
    named = cover_all([table.anchors(x) for x in s_tokens], by_target)
    n, m = len(sources), len(targets)
    i, j = np.arange(n)[:, None], np.arange(m)[None, :]
    same_row = np.array([r for r, _ in sources])[:, None] == np.array([r for r, _ in targets])[None, :]
    value = forward + 0.5 * backward + 0.03 * same_row - 0.02 * np.abs(i / n - j / m) - 1e-9 * np.abs(i - j)
    holds = np.where((named >= 0.7) | ~(named > 0).any(1, keepdims=True), forward, 0.0)
    to_t = np.where(forward > 0, value, -np.inf)
    to_s = np.where((forward > 0) | (backward > 0), value, -np.inf)
    best_t, best_s = to_t.argmax(1), to_s.argmax(0)
    mutual = (best_s[best_t] == np.arange(n)) & (forward[np.arange(n), best_t] >= pair_at)
    pairs = {k: int(best_t[k]) for k in np.flatnonzero(mutual).tolist()}
    # a sentence whose own best is taken may still be best with another that is free
    taken = set(pairs.values())
    reach = forward.max(1)
    for k in sorted((k for k in range(n) if k not in pairs and reach[k] > 0), key=lambda k: -reach[k]):
        free = [x for x in np.flatnonzero((holds[k] >= grow_at) & (backward[k] >= 0.5)).tolist() if x not in taken]
        joined = _neighbour(k, pairs, holds, grow_at)
        if free:
            x = max(free, key=lambda x: value[k, x])
            if joined is None or value[k, x] >= value[k, joined]:
                pairs[k] = x
                taken.add(x)
    for k in [k for k in range(n) if k not in pairs]:  # grow neighbouring merges
        x = _neighbour(k, pairs, holds, grow_at)
        if x is not None:
            pairs[k] = x
    return sorted(pairs.items())


def _neighbour(i: int, pairs: dict[int, int], holds: np.ndarray, grow_at: float) -> int | None:
    """The counterpart of a neighbour of sentence i that holds its translation too."""
    options = [pairs[k] for k in (i - 1, i + 1) if k in pairs and holds[i, pairs[k]] >= grow_at]
    return max(options, key=lambda j: holds[i, j]) if options else None


_WORD_RUN = re.compile(r"[^\W\d_]+")


def _is_english(text: str) -> bool:
    letters = "".join(_WORD_RUN.findall(text))
    return len(letters.encode("ascii", "ignore")) > 0.5 * len(letters) if letters else True


def _align(table: TranslationTable, boundaries: BoundaryModel):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for key, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sources, targets, s_at, t_at = [], [], [], []
                for number, row in enumerate(rows or (), 1):
                    for side, places, text in ((sources, s_at, row and row["source"]), (targets, t_at, row and row["edited"])):
                        for a, b in sentence_spans(text, boundaries) if text else ():
                            if side is targets and _is_english(text[a:b]):
                                continue
                            side.append((number, text[a:b]))
                            places.append((number, a))
                for i, j in match(sources, targets, table) if sources and targets else ():
                    for column, v in zip(out, (key, *s_at[i], *t_at[j]), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.int32()) for x in out[1:])], ["batch_id", "src_row", "src_start", "tgt_row", "tgt_start"])

    return align


def fit_alignment(batches: DataFrame) -> tuple[TranslationTable, BoundaryModel]:
    """Tables and sentence model learned from all rows of the batches."""
    rows = batches.select(F.explode("rows").alias("r")).select("r.source", "r.edited").where("source is not null and edited is not null")
    texts = rows.select("source").unionByName(rows.select(F.col("edited").alias("source")))
    return TranslationTable.learn(rows), learn_boundaries(texts)


def align_batches(batches: DataFrame, table: TranslationTable, boundaries: BoundaryModel) -> DataFrame:
    """(batch_id, src_row, src_start, tgt_row, tgt_start): the pairs of sentences of each batch that translate each other.

    ``batches``: batch_id, rows (array of structs with source and edited). Rows count from 1, starts from 0. Null arrays, rows and texts hold no
    sentence; English sentences of ``edited`` are no translation. A sentence joined from two gives two rows, one
    without counterpart none. Repeated batches give their rows once; a null batch_id gives none. Other columns are ignored.
    """
    rows = batches.where("batch_id is not null").select(F.col("batch_id").cast("long").alias("batch_id"), F.transform("rows", lambda r: F.struct(r["source"].alias("source"), r["edited"].alias("edited"))).alias("rows"))
    return rows.mapInArrow(_align(table, boundaries), "batch_id long, src_row int, src_start int, tgt_row int, tgt_start int").distinct()
