"""Detection and repair of text that was read with the wrong character encoding: the model.

A *unit* is a run of non-ASCII characters with the letters next to it. A multinomial model on hashed byte bigrams of
units tells clean text from the output of each *chain* (written in A, read as B, possibly twice). It is trained on
units of the corpus itself, garbled synthetically through every chain and also through what is commonly done to text
afterwards (case, normal forms, loss of control characters). The training units aren't labelled, so the fit is
repeated without the documents that the first fit finds garbled.

A document is a case if the log odds of some chain, summed over a stretch of its units, pass a threshold. The chain of
each unit is inverted; what decodes strictly, and reads more like clean text than before, is restored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

#: Buckets of hashed byte bigrams.
BUCKETS = 1 << 16
#: Share of each class's probability that is spread evenly over all buckets.
FLOOR = 0.02
#: Log odds at which a unit whose inversion is strict UTF-8 is a case, one with characters that a reader has refused, a
#: stretch whose inversion reads as clean text, and any other stretch.
STRICT, LOST, VERIFIED, UNVERIFIED = 3.0, 3.0, 14.0, 45.0
#: Weight of each letter that all classes know beside the units of the sample, however small or plain the sample is.
LETTER = 1e-3
#: Part of each chain's weight that goes to a misread byte order mark, which the units of a sample never hold.
MARK = 1e-3
#: Share of the sample's documents (and least number) from which a unit counts as known, however unusual its bigrams.
KNOWN, KNOWN_LEAST = 0.001, 4
#: Languages from which on a unit counts as a shared symbol.
SHARED = 3
#: Fits, each without the documents that the one before finds garbled.
ROUNDS = 3
#: Languages with a class of their own; the rarest beyond that share the commonest one's.
MOST_LANGUAGES = 24
#: Distinct units scored at once.
BLOCK = 4000
#: Scores kept by a worker.
MEMO = 100_000

# The ideographic full stop only ends units: without it the phrases of unspaced scripts recur.
UNIT = re.compile(r"[A-Za-z]{0,3}[^\x00-\x7f。]+(?:[A-Za-z]{1,12}[^\x00-\x7f。]+)*[A-Za-z]{0,3}")
PART = re.compile(r"[^\x00-\x7f]{2,}")
# Two-byte text read byte by byte, low or high byte first: letters between low control characters.
WIDE = re.compile(r"(?:[\x00-\xff][\x00-\x05]){3,}|(?:[\x00-\x05][\x00-\xff]){3,}")
LETTERS = "".join(chr(c) for a, b in ((0xC0, 0x180), (0x390, 0x3D0), (0x410, 0x450)) for c in range(a, b) if chr(c).isalpha())
REFUSED = "�"


def _single_byte_table(codec: str) -> tuple[str, dict[str, int]]:
    """Characters of the 256 bytes; bytes that the codec leaves open read as the control character of that number."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return "".join(chars), {c: b for b, c in reversed(list(enumerate(chars)))}


SINGLE = ("latin-1", "cp1252", "cp1251", "cp1250", "iso8859-2", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8-r", "iso8859-5", "iso8859-15")
_TABLES = {c: _single_byte_table(c) for c in SINGLE}


def read_as(raw: bytes, codec: str) -> str:
    """What a lenient reader makes of bytes."""
    if codec in _TABLES:
        chars = _TABLES[codec][0]
        return "".join([chars[b] for b in raw])
    return raw.decode(codec, errors="replace")


def written_in(text: str, codec: str) -> bytes | None:
    """Strict inverse of `read_as`; None if the text can't have come from it."""
    if codec in _TABLES:
        back = _TABLES[codec][1]
        try:
            return bytes([back[c] for c in text])
        except KeyError:
            return None
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


@dataclass(frozen=True)
class Chain:
    """Pairs (written in, read as), in the order in which they happened."""

    steps: tuple[tuple[str, str], ...]

    @property
    def name(self) -> str:
        return ", ".join(f"{a} read as {b}" for a, b in self.steps)

    def garble(self, text: str) -> str | None:
        for a, b in self.steps:
            raw = written_in(text, a)
            if raw is None:
                return None
            text = read_as(raw, b)
        return text

    def restore(self, text: str) -> str | None:
        """Strict inverse: every step must decode without error."""
        for a, b in reversed(self.steps):
            raw = written_in(text, b)
            if raw is None:
                return None
            try:
                text = raw.decode(a)
            except (UnicodeDecodeError, LookupError):
                return None
        return text


def chains() -> list[Chain]:
    one = [("utf-8", b) for b in ("latin-1", "cp1252", "cp1251", "cp1250", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8-r", "gb18030", "gbk", "shift_jis", "cp932", "big5", "euc_kr", "ascii", "iso8859-15", "iso8859-2", "iso8859-5")]
    one += [("utf-16-le", "latin-1"), ("utf-16-be", "latin-1")]
    one += [("cp1252", b) for b in ("cp1251", "cp1250", "cp437", "cp850", "mac_roman", "koi8-r", "utf-8", "gbk")]
    one += [("cp1250", b) for b in ("cp1252", "cp1251", "iso8859-2", "utf-8", "mac_roman")] + [("iso8859-2", b) for b in ("cp1252", "cp1250", "utf-8")]
    one += [("cp1251", b) for b in ("cp1252", "koi8-r", "mac_roman", "cp866", "utf-8", "cp437", "iso8859-5")] + [("koi8-r", b) for b in ("cp1251", "cp1252", "utf-8", "cp866")]
    one += [("cp866", "cp1251"), ("cp866", "cp1252"), ("iso8859-5", "cp1251"), ("mac_roman", "cp1252"), ("mac_roman", "utf-8"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp852", "cp1250")]
    one += [("gbk", b) for b in ("cp1252", "latin-1", "utf-8", "cp1251", "big5", "shift_jis")]
    twice = [(("utf-8", a), ("utf-8", b)) for a, b in (("cp1252", "cp1252"), ("latin-1", "latin-1"), ("latin-1", "cp1252"), ("cp1251", "cp1251"), ("cp1250", "cp1250"), ("cp437", "cp437"), ("mac_roman", "mac_roman"))]
    return [Chain((s,)) for s in one] + [Chain(t) for t in twice]


def afterwards(text: str) -> Iterable[str]:
    """The text, and what is commonly left of it."""
    yield text
    yield text.upper()
    yield text.lower()
    yield unicodedata.normalize("NFKC", text)
    yield unicodedata.normalize("NFD", text)
    yield re.sub("[\x80-\x9f\xad]", "", text)


#: What single-byte readers make of a byte order mark in UTF-8.
MARKS = tuple(dict.fromkeys(read_as(b"\xef\xbb\xbf", c) for c in SINGLE))


def prepare(text: str) -> tuple[str, str]:
    """(misread byte order mark or nothing, rest). A right one is dropped; character references are resolved: garbling
    may have happened before the text was escaped."""
    if "&" in text:
        text = html.unescape(text)
    text = text.lstrip("\ufeff")
    mark = next((m for m in MARKS if text.startswith(m)), "")
    return mark, text[len(mark) :]


def units_of(text: str) -> list[str]:
    """Units of a text in order; a misread byte order mark is one, and runs of two-byte text come first."""
    wide = "\x00" in text
    if not wide and text.isascii() and "&" not in text:
        return []
    mark, rest = prepare(text)
    runs = WIDE.findall(rest) if wide else []
    if runs:
        rest = WIDE.sub(" ", rest)
    return [*([mark] if mark else ()), *runs, *UNIT.findall(rest)]


def bigrams(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every byte bigram, number of bigrams per unit); every unit is set between blanks.

    A bigram is a byte with the next one, or with the one after next: in scripts of two bytes a letter, the latter
    ties a letter to the next.
    """
    raw = [u.encode("utf-8", errors="surrogatepass") for u in units]
    sizes = np.array([len(r) + 1 for r in raw])
    flat = np.frombuffer(b" " + b"  ".join(raw) + b"  ", dtype=np.uint8).astype(np.uint32)
    first = np.r_[0, np.cumsum(sizes + 1)[:-1]]  # places of the blanks before the units
    at = np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    near = (flat[at] * 257 + flat[at + 1]) * np.uint32(2654435761)
    far = (flat[at] * 257 + flat[at + 2] + 70_001) * np.uint32(2654435761)
    pair = np.stack([near >> np.uint32(16), far >> np.uint32(16)], axis=1).ravel()
    return pair.astype(np.int64) & (BUCKETS - 1), 2 * sizes


@dataclass
class Model:
    """Log probabilities bucket x class; the first `tongues` classes are clean text, one per language of the sample."""

    chains: list[Chain]
    tongues: int
    logp: np.ndarray
    known: dict[str, float]  # units of the sample that recur → log of their share
    usual: float  # log probability per bigram that nearly all clean units reach

    def odds(self, units: list[str]) -> np.ndarray:
        """Log odds of each chain against clean text: units x chains."""
        out = np.zeros((len(units), len(self.chains)), dtype=np.float32)
        for lo in range(0, len(units), BLOCK):
            part = units[lo : lo + BLOCK]
            bucket, sizes = bigrams(part)
            s = np.add.reduceat(self.logp[bucket], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
            clean = np.maximum(s[:, : self.tongues].max(axis=1), [self.known.get(u, -np.inf) for u in part])
            out[lo : lo + BLOCK] = s[:, self.tongues :] - clean[:, None]
        return out

    def clean(self, unit: str) -> float:
        """Log probability per bigram as clean text; 0 for plain ASCII, which needs no reading."""
        if unit.isascii() and "\x00" not in unit:
            return 0.0
        bucket, _ = bigrams([unit])
        return float(self.logp[bucket, : self.tongues].mean(axis=0).max())


def _capitals(counts: Counter) -> Counter:
    out: Counter = Counter()
    for u, n in counts.items():
        if (v := u.upper()) != u and not v.isascii():
            out[v] += n
    return out


def fit(by_tongue: list[Counter], known: list[Chain], often: dict[str, int] | None = None) -> Model:
    """Multinomial fit on units with their numbers of occurrences per language, garbled through every chain.

    Clean text has a class per language: pooled, its probabilities would be so thin that any chain which only
    touches one language would suit that language's clean units better. Units seen `often` (with the number of their
    languages) are known whatever their bigrams, unless a chain's inverse reads as clean text; symbols that several
    languages share only if that inverse is strict UTF-8.
    """
    counts = sum(by_tongue, Counter())
    # Capitals have classes of their own, and units that are rare in each language one in which they aren't.
    by_tongue = [*by_tongue, *(_capitals(c) for c in by_tongue), counts]
    tongues = len(by_tongue)
    table = np.zeros((BUCKETS, tongues + len(known)), dtype=np.float64)

    def put(column: int, units: dict[str, float]) -> None:
        if units:
            bucket, sizes = bigrams(list(units))
            weights = np.repeat(np.fromiter(units.values(), dtype=float), sizes)
            table[:, column] += np.bincount(bucket, weights, BUCKETS)

    for i, own in enumerate(by_tongue):
        clean: dict[str, float] = {}
        for u, n in own.items():
            for k, v in enumerate(afterwards(u)):
                if not v.isascii() and (k == 0 or v != u):
                    clean[v] = clean.get(v, 0.0) + (n**0.75 if k == 0 else n**0.75 * 0.1)
        put(i, clean)
    put(tongues - 1, dict.fromkeys(LETTERS, LETTER))
    weight = {u: n**0.75 for u, n in counts.items()}
    for i, chain in enumerate(known, start=tongues):
        made: dict[str, float] = {}
        for u, w in weight.items():
            g = chain.garble(u)
            # Where the outcome is the commoner unit of the corpus, the unit itself is the garbled one.
            if g is None or g == u or g.isascii() or counts.get(g, 0) >= counts[u]:
                continue
            for k, v in enumerate(afterwards(g)):
                if not v.isascii() and (k == 0 or v != g) and counts.get(v, 0) < counts[u]:
                    made[v] = made.get(v, 0.0) + (w if k == 0 else w * 0.1)
        own = sum(made.values())
        for c in LETTERS:
            if (g := chain.garble(c)) and g != c and not g.isascii():
                made[g] = made.get(g, 0.0) + LETTER
        if chain.steps[0][0] == "utf-8" and (g := chain.garble("\ufeff")):
            made[g] = made.get(g, 0.0) + max(LETTER, MARK * own)
        put(i, made)
    share = table / np.maximum(table.sum(axis=0), 1e-9)
    logp = np.log((1 - FLOOR) * share + FLOOR / BUCKETS).astype(np.float32)
    total = max(1, sum(counts.values()))
    model = Model(known, tongues, logp, {}, 0.0)
    common = sorted(counts, key=counts.get, reverse=True)[:2000]
    model.usual = float(np.quantile([model.clean(u) for u in common], 0.03)) if common else 0.0
    often = {u: n for u, n in (often or {}).items() if counts[u] and u not in MARKS}
    judge = Judge(model)
    judge.learn(set(often))

    def safe(u: str) -> bool:
        if judge.strictly(u):
            return False
        # A single character is too little to go by.
        return sum(not c.isascii() for c in u) == 1 or often[u] >= SHARED or not judge.fixable(u, VERIFIED)

    model.known = {u: float(np.log(counts[u] / total)) for u in often if safe(u)}
    return model


class Judge:
    """Verdicts on whole texts; scores of units seen before are kept."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[str, np.ndarray] = {}
        self.strict = np.array([i for i, c in enumerate(model.chains) if all(a == "utf-8" for a, _ in c.steps)])

    def learn(self, units: set[str]) -> None:
        """Keep the log odds of units; None for those that no chain explains better than clean text."""
        new = [u for u in units if u not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(units)
        if new:
            odds = self.model.odds(new)
            self.memo.update((u, o if top > 0 else None) for u, o, top in zip(new, odds, odds.max(axis=1).tolist(), strict=True))

    def fixable(self, unit: str, least: float) -> bool:
        odds = self.memo[unit]
        return odds is not None and odds.max() >= least and self.restored(unit, np.argsort(-odds)[:3]) is not None

    def strictly(self, unit: str) -> tuple[int, str] | None:
        """Chain and original of a unit, or of a part of it, that is strict UTF-8 read as something else."""
        odds = self.memo[unit]
        if odds is None or odds[self.strict].max() < STRICT:
            return None
        order = self.strict[np.argsort(-odds[self.strict])[:4]]
        order = order[odds[order] >= STRICT]
        return self.restored(unit, order) or next((g for part in PART.findall(unit) if part != unit and (g := self.restored(part, order))), None)

    def restored(self, unit: str, order: np.ndarray) -> tuple[int, str] | None:
        """The likeliest chain (of the first few) whose strict inverse reads more like clean text than the unit."""
        before = self.model.clean(unit)
        for c in order:
            back = self.model.chains[c].restore(unit)
            if not back or back == unit or REFUSED in back:
                continue
            bare = back.lstrip("\ufeff")
            shown = "".join(bare.split()).isprintable()
            if not bare or bare.isascii():  # a byte order mark, a mark of punctuation
                good = shown
            elif "\x00" in unit:  # whole sentences: most of their own units must read well
                inner = UNIT.findall(bare)
                good = shown and 2 * sum(u in self.model.known or self.model.clean(u) >= self.model.usual for u in inner) >= len(inner)
            else:
                after = 0.0 if bare in self.model.known else self.model.clean(bare)
                good = after > before and after >= self.model.usual and shown
            if good:
                return int(c), back
        return None

    def stretch(self, units: list[str]) -> tuple[float, int, int, int]:
        """(log odds, chain, first unit, last unit) of the best stretch: the largest sum over consecutive units.

        A unit that no chain explains ends all stretches.
        """
        width = len(self.model.chains)
        run, start = np.zeros(width, dtype=np.float32), np.zeros(width, dtype=np.int64)
        best = (0.0, -1, 0, 0)
        for i, u in enumerate(units):
            row = self.memo[u]
            if row is None:
                run = np.zeros(width, dtype=np.float32)
                continue
            fresh = run <= 0
            run = np.where(fresh, row, run + row)
            start = np.where(fresh, i, start)
            c = int(run.argmax())
            if run[c] > best[0]:
                best = (float(run[c]), c, int(start[c]), i)
        return best

    def verdict(self, units: list[str]) -> tuple[bool, float, int]:
        """(garbled, log odds, chain) for the units of a text, in order."""
        if all(self.memo[u] is None for u in units):
            return False, 0.0, -1
        for u in dict.fromkeys(units):
            if REFUSED in u and (odds := self.memo[u]) is not None and odds.max() >= LOST:  # nothing to invert
                return True, float(odds.max()), int(odds.argmax())
            if got := self.strictly(u):
                return True, float(self.memo[u][got[0]]), got[0]
        score, chain, a, b = self.stretch(units)
        if score < VERIFIED or score >= UNVERIFIED:
            return score >= UNVERIFIED, score, chain
        return any(self.restored(u, np.array([chain])) for u in set(units[a : b + 1])), score, chain

    def repair(self, text: str) -> tuple[str, int, int, Counter]:
        """(text with every unit restored where possible, units restored, units left garbled, chains)."""
        mark, rest = prepare(text)
        done, left, used = int(bool(mark)), 0, Counter()

        def narrow(m: re.Match) -> str:
            nonlocal done
            odds = self.memo.get(m.group())
            got = None if odds is None else self.restored(m.group(), np.argsort(-odds)[:3])
            done += int(got is not None)
            return got[1] if got else m.group()

        if "\x00" in rest:
            rest = WIDE.sub(narrow, rest)
        # The text was most likely garbled once: the chain that explains most units is tried first on all of them.
        votes = Counter(got[0] for u in UNIT.findall(rest) if (o := self.memo.get(u)) is not None and (got := self.restored(u, np.argsort(-o)[:6])))
        main = votes.most_common(1)[0][0] if votes else None
        sure = main is not None and votes[main] >= 3

        def one(m: re.Match) -> str:
            nonlocal done, left
            unit = m.group()
            odds = self.memo.get(unit)
            if odds is None and not sure:
                return unit
            order = np.zeros(0, dtype=np.int64) if odds is None else np.argsort(-odds)[:6]
            order = order if odds is None else order[odds[order] > 0]
            if sure:  # what one chain left over isn't explained by another alphabet
                order = np.array([c for c in order if self.model.chains[c].steps[0][0] == self.model.chains[main].steps[0][0]], dtype=np.int64)
            if sure and (back := self.model.chains[main].restore(unit)) and back != unit and REFUSED not in back and (odds is not None or self.restored(unit, np.array([main]))):
                got = (main, back)
            else:
                got = self.restored(unit, order)
            if got:
                done += 1
                used[self.model.chains[got[0]].name] += 1
                return got[1]
            fixed = PART.sub(lambda p: g[1] if (g := self.restored(p.group(), order)) else p.group(), unit)
            done += int(fixed != unit)
            left += int(fixed == unit and odds is not None and odds.max() > VERIFIED)
            return fixed

        return UNIT.sub(one, rest), done, left, used


def suspects(counts: Counter, known: list[Chain]) -> set[str]:
    """Units whose strict inverse from UTF-8 is a commoner unit of the corpus."""
    own = [c for c in known if all(a == "utf-8" for a, _ in c.steps)]
    return {u for u, n in counts.items() if any((back := c.restore(u)) and back != u and counts.get(back, 0) > n for c in own)}


def train(texts: list[str], languages: list[str | None], known: list[Chain] | None = None) -> Model:
    """Fit on the units of `texts`, then again without the texts the fit before finds garbled."""
    known = known or chains()
    common = [k for k, _ in Counter(languages).most_common(MOST_LANGUAGES)]
    slot = {k: i for i, k in enumerate(common)}
    found = [(slot.get(k, 0), units_of(t)) for t, k in zip(texts, languages, strict=True)]
    spread = Counter(u for _, us in found for u in set(us))
    shared: dict[str, set] = {}
    for k, us in found:
        for u in us:
            shared.setdefault(u, set()).add(k)
    often = {u: len(shared[u]) for u, n in spread.items() if n >= max(KNOWN_LEAST, KNOWN * len(texts))}
    odd = suspects(Counter(u for _, us in found for u in us), known)
    kept = [(k, us) for k, us in found if not any(u in MARKS or REFUSED in u or u in odd for u in us)]
    for turn in range(ROUNDS):
        by_tongue = [Counter() for _ in range(max(1, len(common)))]
        for k, us in kept:
            by_tongue[k].update(us)
        model = fit(by_tongue, known, often)
        if turn < ROUNDS - 1:
            judge = Judge(model)
            units = {u for _, us in kept for u in us}
            judge.learn(units)
            gone = {u for u in units if judge.fixable(u, VERIFIED)}
            kept = [(k, [u for u in us if u not in gone]) for k, us in kept]
    return model
