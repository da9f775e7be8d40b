"""Plain versions of the operators for small tables, written from the contracts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def bench_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def fingerprint(text: str) -> int:
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps: dict) -> dict:
    """key -> least key reachable over fingerprints at most two bits apart."""
    keys = sorted(fps)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    values = np.array([fps[k] for k in keys], np.uint64)
    for i, k in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 2):
            a, b = root(k), root(keys[i + 1 + int(j)])
            parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


def edit_distance_one(a: list[str], b: list[str]) -> bool:
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def removed_lines(docs: list[tuple[int, str | None]], edit_words: int = 8, edit_chars: int = 16) -> dict[int, list[int]]:
    """Per key the numbers of lines that go; keys are distinct. Edits are words in long lines, characters in shorter ones."""
    seen: dict[str, list] = {"words": [], "chars": []}
    exact: set[tuple] = set()
    out: dict[int, list[int]] = {}
    for key, text in sorted(docs):
        out[key] = []
        for number, line in enumerate((text or "").split("\n")):
            w = words(line)
            if not w:
                continue
            kind, symbols = ("words", w) if len(w) >= edit_words else ("chars", list(" ".join(w)))
            compared = kind == "words" or len(symbols) >= edit_chars
            if tuple(w) in exact or (compared and any(edit_distance_one(s, symbols) for s in seen[kind])):
                out[key].append(number)
            if tuple(w) not in exact:
                exact.add(tuple(w))
                if compared:
                    seen[kind].append(symbols)
    return out


def decontaminated(text: str, items: list[tuple[str, str]]) -> tuple[int, set[int], set[str]]:
    w = bench_words(text)
    hit: set[int] = set()
    found: set[str] = set()
    for item, t in items:
        x = bench_words(t)
        n = min(10, len(x))
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(w), hit, found


def rejected(text: str | None) -> bool:
    """By the rules of the pipeline's policy."""
    text = text or ""
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    repeated = {i + k for i in range(len(own) - 4) if windows[tuple(own[i : i + 5])] > 1 for k in range(5)}
    symbols, length = len(re.findall(r"[#*$%&|<>]", text)), sum(map(len, own))
    return len(own) < 10 or 100 * len(repeated) > 20 * len(own) or 10 * symbols > len(own) or 2 * (len(lines) - len(set(lines))) > len(lines) or length < 2 * len(own) or length > 20 * len(own)


def without_hits(text: str | None, hit: set[int]) -> str | None:
    """The text without the hit words: runs of neighbouring ones go with what lies between them, and one of two spaces around them."""
    if not hit:
        return text
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))]
    out, at, i = "", 0, 0
    while i < len(places):
        if i not in hit:
            i += 1
            continue
        j = i
        while j + 1 in hit:
            j += 1
        start, end = places[i][0], places[j][1]
        out += text[at:start]
        at = end + (text[:start].endswith(" ") and text[end : end + 1] == " ")
        i = j + 1
    return out + text[at:]


class Katz:
    """Bigram Katz back-off with Good-Turing discounts up to k; larger counts lose ``large``."""

    def __init__(self, texts: list[str], k: int = 5, large: float = 0.5) -> None:
        self.unigrams, self.pairs, self.k, self.large = Counter(), Counter(), k, large
        self.histories = Counter()
        for t in texts:
            tokens = [*words(t), None]
            self.unigrams.update(tokens)
            for h, w in zip(["<s>", *tokens], tokens):
                self.pairs[h, w] += 1
                self.histories[h] += 1
        self.n, self.v = sum(self.unigrams.values()), len(self.unigrams)
        self.d1, self.d2 = self.discounts(self.unigrams), self.discounts(self.pairs)
        kept = sum(self.d1(c) for c in self.unigrams.values())
        self.unknown = (self.n - kept) / self.n
        self.followers = defaultdict(set)
        for h, w in self.pairs:
            self.followers[h].add(w)

    def discounts(self, counts: Counter):
        of = Counter(counts.values())
        large = (self.k + 1) * of[self.k + 1] / of[1] if of[1] else 1.0

        def star(r: int) -> float:
            if r > self.k:
                return r - self.large
            d = ((r + 1) * of[r + 1] / (r * of[r]) - large) / (1 - large) if of[r] and large < 1 else 0.0
            return d * r if 0 < d < 1 else r - self.large

        return star

    def p1(self, w) -> float:
        return self.d1(self.unigrams[w]) / self.n if w in self.unigrams else self.unknown

    def p2(self, h, w) -> float:
        if h not in self.histories:
            return self.p1(w)
        if (h, w) in self.pairs:
            return self.d2(self.pairs[h, w]) / self.histories[h]
        kept_back = 1 - sum(self.d2(self.pairs[h, x]) for x in self.followers[h]) / self.histories[h]
        left = max(1 - sum(self.p1(x) for x in self.followers[h]), self.unknown)
        return kept_back / left * self.p1(w)

    def score(self, text: str) -> float:
        tokens = [*words(text), None]
        return sum(math.log10(self.p2(h, w)) for h, w in zip(["<s>", *tokens], tokens))

    def base(self, text: str) -> float:
        return sum(math.log10((self.unigrams[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in [*words(text), None])


def crc(key, modulus: int) -> int:
    return zlib.crc32(str(key).encode()) % modulus


class KatzN:
    """Katz back-off of any order, by recursion over dictionaries."""

    def __init__(self, texts: list[str], n: int, k: int = 5, large: float = 0.5) -> None:
        self.n, self.k, self.large = n, k, large
        self.counts = [Counter() for _ in range(n + 1)]
        for t in texts:
            tokens = [*["<s>"] * (n - 1), *words(t), "</s>"]
            for i in range(n - 1, len(tokens)):
                for order in range(1, n + 1):
                    self.counts[order][tuple(tokens[i - order + 1 : i + 1])] += 1
        self.stars = [None, *(Katz.discounts(self, c) for c in self.counts[1:])]
        self.totals, self.followers = Counter(), defaultdict(set)
        for order in range(1, n + 1):
            for gram, c in self.counts[order].items():
                self.totals[gram[:-1]] += c
                self.followers[gram[:-1]].add(gram[-1])
        self.unknown = 1 - sum(self.star((w,)) for w in self.followers[()])

    def star(self, gram: tuple) -> float:
        return self.stars[len(gram)](self.counts[len(gram)][gram]) / self.totals[gram[:-1]]

    def p(self, history: tuple, w: str) -> float:
        gram = (*history, w)
        if self.counts[len(gram)][gram]:
            return self.star(gram)
        if not history:
            return self.unknown
        lower = self.p(history[1:], w)
        if history not in self.totals:
            return lower
        left = 1 - sum(self.p(history[1:], x) for x in self.followers[history])
        return (1 - sum(self.star((*history, x)) for x in self.followers[history])) / left * lower

    def score(self, text: str) -> float:
        tokens = [*["<s>"] * (self.n - 1), *words(text), "</s>"]
        return sum(math.log10(self.p(tuple(tokens[i - self.n + 1 : i]), tokens[i])) for i in range(self.n - 1, len(tokens)))


class Toxicity:
    """Class-conditional Kneser-Ney over the characters of words: own counts of the longest grams, shared lower orders."""

    def __init__(self, texts: list[tuple[str, int]], order: int = 5, discount: float = 0.75) -> None:
        self.order, self.d = order, discount
        self.own = {0: Counter(), 1: Counter()}
        for text, label in texts:
            for w in text.lower().split():
                for context, x in self.places(w):
                    self.own[label][context, x] += 1
        longest = {g for c in self.own.values() for g in c}
        # shared[k]: of grams of k characters, in how many contexts they stand (at the start of a word: how often)
        self.shared = [Counter() for _ in range(order)]
        for context, x in longest:
            if len(context) == order - 1:
                self.shared[order - 1][context[1:], x] += 1
            else:
                self.shared[len(context) + 1][context, x] += sum(c[context, x] for c in self.own.values())
        for k in range(order - 1, 1, -1):
            for context, x in self.shared[k]:
                self.shared[k - 1][context[1:], x] += 1
        self.characters = len(self.shared[1]) + 1

    def places(self, word: str):
        marked = "\x02" + word + "\x03"
        for i in range(1, len(marked)):
            yield marked[max(0, i - self.order + 1) : i], marked[i]

    def discounted(self, counts: Counter, context: str, x: str, lower: float) -> float:
        after = [n for (c, _), n in counts.items() if c == context]
        if not after:
            return lower
        return (max(counts[context, x] - self.d, 0) + self.d * len(after) * lower) / sum(after)

    def p(self, label: int, context: str, x: str) -> float:
        p = 1 / self.characters
        start = context[1:] if len(context) == self.order - 1 else context
        for k in range(len(start) + 1):
            p = self.discounted(self.shared[k + 1], start[len(start) - k :], x, p)
        return self.discounted(self.own[label], context, x, p)

    def values(self, text: str, floor: float = 3.0) -> tuple[float, float]:
        words = text.lower().split()
        of = [sum(math.log(self.p(1, c, x) / self.p(0, c, x)) for c, x in self.places(w)) for w in words]
        characters = sum(len(w) + 1 for w in words)
        return (sum(of) / characters, sum(r - floor for r in of if r > floor) / len(words)) if words else (0.0, 0.0)


def language_features(text: str, bits: int = 13) -> dict[int, float]:
    """Hashed grams of one to three bytes of the letters, scaled to length one."""
    raw = text.lower().encode()
    raw = b" " + b" ".join(bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in raw).split()) + b" "
    counts = Counter()
    for k in range(3):
        for i in range(len(raw) - k):
            code = int.from_bytes(raw[i : i + k + 1], "big") + (k << 24)
            counts[(code * 2654435761 & 0xFFFFFFFF) >> (32 - bits)] += 1
    length = math.sqrt(sum(n * n for n in counts.values()))
    return {at: n / length for at, n in counts.items()}


def language(text: str, families: dict[str, list[str]], of_family: dict[str, list[float]], of_pair: dict[tuple[str, str], list[float]]) -> str:
    """The family with the largest margin, and in it the language with most duels won (then the largest sum of margins)."""
    if not any(c.isalpha() for c in text):
        return "und"
    x = language_features(text)
    margin = lambda w: sum(v * w[at] for at, v in x.items()) + w[-1]
    family = max(families, key=lambda f: margin(of_family[f])) if len(families) > 1 else next(iter(families))
    votes = {name: [0, 0.0] for name in families[family]}
    for (a, b), w in of_pair.items():
        if a in votes:
            m = margin(w)
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
    return max(votes, key=votes.get)
