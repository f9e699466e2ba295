"""Quality and weakness of a label at once, from what is kept of its words; whole columns go through operators.repair.

Labels repeat their words, so a word is judged once, and a label of plain words adds up what is kept. Where a word, or two
neighbours, may be rewritten by the repair, and for labels of any other shape, the rules of Repair themselves decide.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

from . import predicates as p
from .lexicon import _FOLD, PHRASES
from .repair import _BORDER, _BORDER_WORD, ADMIN_TAILS, BRANCHES, CROSSINGS, REPEATABLE, STRAY_LONG, Repair, artifacts, better_repeat, edit_distance, gibberish_of, meaningless, stray_head, weak_segment
from .text import MARK, TOKEN

#: Words that are kept at once; as many of those before them are kept too, until so many more have come.
KEPT = 1 << 16

# A rating and a count before a label, as maps show them.
HEAD = re.compile(r"[0-9][.,][0-9] \([1-9][0-9]{0,2}[KM]\) · ", re.ASCII)
_TOKEN = re.compile(TOKEN)
_AZ = re.compile("[a-z0-9]")
_MARK = re.compile(MARK)
_BAD = re.compile("|".join(p.BAD_PARTS))
_JUNK_ENDS = ("ness", "tess", "cess", "erian", "minery")
_JUNK_WORDS = frozenset(p.JUNK_WORDS)
_JUNK_HEADS = tuple(p.JUNK_HEADS)
_NOISE_HEADS = (*p.JUNK_HEADS, *p.MORE_HEADS)
_JUNK_TAILS, _TOKEN_JUNK, _ADMIN = tuple(p.TOKEN_TAILS), frozenset(p.TOKEN_JUNK), frozenset(p.ADMIN_KEYS)
#: Two neighbours that a rule rewrites or marks.
_PAIRS = {x[:2] for x in (*(source for source, _ in PHRASES), *BRANCHES, ("nha", "va")) if len(x) > 1}
_PAIR_HEADS = {a for a, _ in _PAIRS}
_SINGLES = {x[0] for x in (*(source for source, _ in PHRASES), *BRANCHES) if len(x) == 1} | {"mplaza"}
_REWRITTEN = frozenset({*_SINGLES, *ADMIN_TAILS, *p.CATEGORY_HEADS})


class Word:
    """What the rules ask of a word. plain: a word of letters alone; steady: no rule rewrites it by itself;
    strange: steady, unknown, and no acronym."""

    __slots__ = ("acronym", "bad", "capital", "dull", "junk", "key", "known", "marked", "mixed", "n", "pairs", "plain", "points", "readable", "small", "steady", "strange", "stray", "text", "title", "upper", "ascii")


class Judge:
    def __init__(self, repair: Repair):
        self.repair = repair
        self._words: dict[str, Word] = {}
        self._older: dict[str, Word] = {}
        self._heads: dict[str, tuple[int, int, int]] = {}
        #: Dictionaries may rewrite any words.
        self._own = not repair.lexicon.phrases and not repair.lexicon.targets
        self._again = lru_cache(1 << 14)(self._plainly)
        self._rewritten = _REWRITTEN | {c[0] for c in repair.lexicon.context} | {k for k, v in repair.lexicon.aliases.items() if v}

    def judge(self, text: str | None) -> tuple[float, bool]:
        """Repair.quality and Repair.needs_rescue of a text."""
        text = text or ""
        head, parts = self._parts(text)
        words = list(chain.from_iterable(parts or ()))
        weak = self._weak(head, parts, words) if parts and self._own else None
        if weak is None:
            return self._again(text) if len(text) <= 256 else self._plainly(text)
        return self._quality(head, parts, words), weak

    def _plainly(self, text: str) -> tuple[float, bool]:
        return self.repair.quality(text), self.repair.needs_rescue(text)

    # -- words ---------------------------------------------------------------------------------

    def _parts(self, text: str) -> tuple[str, list[list[Word]] | None]:
        """The rating before a label, and its segments' words; no words unless all are plain and at least three."""
        head, n = "", 0
        if text[:1].isdigit():
            m = HEAD.match(text)
            if m is None:
                return "", None
            head, text = m[0], text[m.end() :]
        kept, parts = self._words, []
        for part in text.split(" / "):
            own = []
            for w in part.split(" "):
                word = kept.get(w)
                if word is None:
                    word = self._word(w)
                if not word.plain:
                    return "", None
                own.append(word)
            n += len(own)
            parts.append(own)
        return head, parts if n > 2 else None

    def _word(self, w: str) -> Word:
        out = self._older.get(w)
        if out is None:
            out = Word()
            if w.isascii() and w.islower() and w.isalpha():
                self._describe_lower(out, w)
            else:
                # Lower case of a sigma depends on its neighbours.
                out.plain = w.isalpha() and "Σ" not in w and _TOKEN.fullmatch(w) is not None
                if out.plain:
                    self._describe(out, w)
        if len(w) <= 64:
            if len(self._words) >= KEPT:
                self._older = dict(self._words)
                self._words.clear()
            self._words[w] = out
        return out

    def _describe_lower(self, out: Word, w: str) -> None:
        """_describe for most words, those of unmarked small letters."""
        n = len(w)
        known = w in self.repair.lexicon.known
        if known or w in _ADMIN:
            junk = False
        elif n > 6:
            junk = w.endswith(_JUNK_TAILS) or w in _TOKEN_JUNK or (n > 7 and sum(map(w.count, "aeiouy")) / n < 0.25)
        else:
            junk = w in _TOKEN_JUNK or (None if n == 1 else False)
        out.plain = out.readable = True
        out.marked = out.upper = out.capital = out.acronym = out.title = out.small = out.mixed = out.dull = False
        out.text = out.key = out.ascii = w
        out.n, out.known, out.junk, out.stray = n, known, junk, None
        out.bad = _BAD.search(w) is not None
        out.points = n - 45 * (junk is True)
        out.pairs = w in _PAIR_HEADS
        out.steady = not (w in self._rewritten or w in _JUNK_WORDS or (w.startswith(_NOISE_HEADS) and _BORDER_WORD.fullmatch(w)))
        out.strange = out.steady and not known

    def _describe(self, out: Word, w: str) -> None:
        own, latin = self.repair, w.isascii()
        low = w.lower()
        out.text = w
        out.key = key = low if latin else low.translate(_FOLD)
        out.n = n = len(w)
        marks = 0 if latin else len(_MARK.findall(w))
        out.marked = marks > 0
        out.known = key in own.lexicon.known
        first = w[0].isupper()
        out.upper = w.isupper()
        out.capital = first or out.upper
        out.acronym = out.upper and 2 <= n <= 6
        out.title = first and n >= 4
        out.small = n <= 3 and out.capital and not marks
        out.ascii = plain = w if latin else re.sub("[^a-zA-Z]", "", w)
        sound = out.known or marks or out.acronym or key in p.ADMIN_KEYS
        out.junk = False if sound else meaningless(w, key)
        out.bad = _BAD.search(key) is not None
        out.readable = _AZ.search(key) is not None
        out.mixed = out.marked and not out.upper and sum(c.isupper() for c in w) >= 2
        out.dull = not out.known and out.upper and n >= 4
        odd = (4 * (n >= 6 and w[0].islower()) + 5 * (n >= 7 and marks >= 3)) if marks >= 2 else 0
        out.points = n + 2 * marks - 14 * odd - 45 * (out.junk is True)
        out.stray = None
        out.pairs = key in _PAIR_HEADS
        # No rule for brands rewrites a word that has no capital but its first, unless that is a crossed D.
        plain_case = w[0] != "Đ" and w[1:].islower()
        small = plain.lower()
        noise = small in _JUNK_WORDS or (small.startswith(_NOISE_HEADS) and _BORDER_WORD.fullmatch(plain))
        out.steady = not noise and key not in self._rewritten and low != "mplaza" and (plain_case or own.latin_brands(w) == w)
        out.strange = out.steady and not out.known and not out.acronym

    # -- quality -------------------------------------------------------------------------------

    def _head(self, head: str) -> tuple[int, int, int]:
        """Digits of a rating, and all its letters and digits; what its artefacts and its lone first digit cost."""
        if head not in self._heads:
            if len(self._heads) >= KEPT:
                self._heads.clear()
            n = sum(c.isdigit() for c in head)
            self._heads[head] = n, n + 1, 14 * artifacts(head.strip()) + 28 + 18
        return self._heads[head]

    def _quality(self, head: str, parts: list[list[Word]], words: list[Word]) -> float:
        numbers, length, cost = self._head(head) if head else (0, 0, 0)
        n = len(words) + (3 if head else 0)
        score = 8 * (len(parts) - 1) + 4 * (n - 1) + length - cost
        bad = marks = False
        for w in words:
            score += w.points
            length += w.n
            if w.bad:
                bad = True
            if w.marked:
                marks = True
        if length <= 4:
            score -= 110
        elif bad:
            score -= 80
        if marks and not head and self._gibberish(words):
            score -= 55
        if numbers and numbers / length > 0.35:
            score -= int(60 * (numbers / length))
        first, last = words[0], words[-1]
        if first.n == 1 and not head:
            score -= 18
        if last.n == 1:
            score -= 12
        inner = bool(head)  # whether words stand before a segment's first
        for own in parts:
            first, last = own[0], own[-1]
            more = len(own) > 1
            if first.n == 1 and not inner:  # only a word of one letter is junk at an edge alone
                score -= 45 * (first.junk is None) + 56 * more
            if last.n == 1 and (more or inner):
                score -= 45 * (last.junk is None) + 30
            if len(own) >= 5 and not inner:
                run = 0
                for w in own[:4]:
                    if not w.small:
                        break
                    run += 1
                if run >= 3 or (run >= 2 and len(own) >= 6):
                    score -= 120
            if not more and not inner and first.n <= 3 and len(parts) > 1 and parts[-1] == own and parts[-2][-1].n >= 7:
                score -= 35
            inner = False
        return score + 0.05

    def _gibberish(self, words: list[Word]) -> bool:
        has = [w.marked for w in words]
        if True not in has or any(w.acronym for w in words):
            return False
        return gibberish_of([w.key for w in words], has, [w.known for w in words], sum(w.capital for w in words), [w.title for w in words])

    # -- weakness ------------------------------------------------------------------------------

    def _weak(self, head: str, parts: list[list[Word]], words: list[Word]) -> bool | None:
        """Whether the cleaned label is weak; None where more may change in it than that it loses noise."""
        if not head:
            # Of strange words the repair leaves some or none, which are weak all the same.
            for w in words:
                if not w.strange:
                    break
            else:
                return True
        clean = True  # whether nothing in it is noise
        for w in words:
            if not w.steady:
                return None
            if w.junk is not False:
                clean = False
        if words[0].acronym and words[1].acronym and not head and edit_distance(words[0].text, words[1].text) <= 1:
            return None
        if self._neighbours(words):
            parts = self._merged(parts)
            if parts is None:
                return None
        inner, kept = bool(head), []
        for own in parts:
            if len(parts) > 1 and not inner:
                plain = "".join([w.ascii for w in own])
                low = plain.lower()
                if not plain or low.endswith(_JUNK_ENDS) or low in _JUNK_WORDS or (low.startswith(_JUNK_HEADS) and _BORDER.fullmatch(plain)):
                    return None
            if len(own) > 2 and not inner and self._drops(own):
                own = own[1:]
            if clean:
                kept.append(own)
                inner = False
                continue
            if inner or own[0].junk is not None:
                own = [w for w in own[:-1] if not w.junk] + own[-1:]
            else:
                own = [w for w in own[1:-1] if not w.junk] + (own[-1:] if len(own) > 1 else [])
            if own and own[-1].junk is not False:
                own = own[:-1]
            if own:
                kept.append(own)
            elif inner:
                return None
            inner = False
        left = list(chain.from_iterable(kept))
        if len(left) < 3:
            return None
        if len(left) < len(words) and self._neighbours(left):
            kept = self._merged(kept)
            if kept is None:
                return None
            left = list(chain.from_iterable(kept))
        if len(kept) > 1:
            if len(kept[0]) == 1 and not head:
                return None
            if len(kept) == 2:
                first, second = kept
                shared, key = 0, second[0].key
                for w in first:
                    if w.key == key:
                        shared = self._overlap(first, second)
                        break
                if shared:
                    kept = [first + second[shared:]]
                elif len(second) > 2 and second[1].key in CROSSINGS:
                    return None
            # A last segment of one word may be a neighbour's.
            if len(kept) > 1 and len(kept[-1]) == 1 and weak_segment(kept[-1][0].text):
                if len(kept) > 2:
                    return None
                kept = kept[:1]
            if len(kept) == 1:
                left = kept[0]
        return self._weak_words(head, kept, left) if len(left) > 2 else None

    def _overlap(self, first: list[Word], second: list[Word]) -> int:
        """How many words the second segment starts with that end the first, and has more."""
        a, b = [w.key for w in first], [w.key for w in second]
        return next((n for n in range(min(len(a), len(b) - 1), 0, -1) if a[-n:] == b[:n]), 0)

    def _neighbours(self, words: list[Word]) -> bool:
        """Whether two neighbours may be alike, or written anew together."""
        before = words[0]
        for w in words[1:]:
            if w.key == before.key or (before.pairs and (before.key, w.key) in _PAIRS):
                return True
            before = w
        return False

    def _merged(self, parts: list[list[Word]]) -> list[list[Word]] | None:
        """repair.drop_repeats of segments; None where more would follow, or neighbours are written anew."""
        out: list[list[Word]] = []
        before: Word | None = None
        place = (0, 0)
        for i, own in enumerate(parts):
            out.append([])
            for at, w in enumerate(own):
                if before is not None and (before.key, w.key) in _PAIRS:
                    return None
                closes = at == len(own) - 1 and i < len(parts) - 1
                if before is not None and not closes and self._repeats(before, w):
                    better = before if better_repeat(before.text, w.text) == before.text else w
                    out[place[0]][place[1]] = before = better
                else:
                    out[i].append(w)
                    before, place = w, (i, len(out[i]) - 1)
        # Of the last segment nothing may be left; the last words of the others stay.
        out = out if out[-1] else out[:-1]
        return out if out == parts or self._merged(out) == out else None

    def _repeats(self, left: Word, right: Word) -> bool:
        if left.key != right.key or len(right.key) < 2 or (left.text != right.text and left.marked and right.marked):
            return False
        return not (left.upper and right.upper) or right.key in REPEATABLE or (left.text == right.text and right.marked)

    def _drops(self, own: list[Word]) -> bool:
        """Whether the first word is a stray one before these others."""
        first, rest = own[0], own[1:]
        if first.known:
            return False
        if len(first.key) > 2:
            for w in rest:
                if w.marked:
                    break
            else:
                return False
        if first.stray is None:
            first.stray = stray_head(first.text, first.known)
        if not first.stray:
            return False
        capitals = sum(w.capital for w in rest) / len(rest)
        if first.stray == "short":
            return capitals >= 0.65 or any(w.upper and w.n >= 2 for w in rest)
        return any(w.marked for w in rest) and (capitals >= 0.5 or (len(rest) >= 4 and first.key.startswith(STRAY_LONG)))

    def _weak_words(self, head: str, parts: list[list[Word]], words: list[Word]) -> bool:
        """Repair.needs_rescue of a label that is clean, of three words or more beside its rating."""
        n, lost, loud, length, odd, readable = len(words), 0, 0, 0, False, bool(head)
        for w in words:
            if w.bad or w.mixed:
                return True
            length += w.n
            readable = readable or w.readable
            if not w.known:
                lost += 1
                odd = odd or w.marked
                loud += w.dull
        if (length <= 4 and not head) or not readable:
            return True
        inner = bool(head)
        if head:  # its count stays, as a word
            token = head[head.index("(") + 1 : head.index(")")]
            strange = not self.repair.lexicon.knows(token)
            n, lost, loud = n + 1, lost + strange, loud + (strange and len(token) >= 4)
        share = lost / n
        if (share >= 0.5 and (odd or lost >= 2)) or loud >= 2 or (n >= 8 and len(parts) > 1 and share >= 0.35):
            return True
        for own in parts:
            if (own[0].junk is None and not inner) or own[-1].junk is None:
                return True
            inner = False
        return not head and self._gibberish(words)


__all__ = ["HEAD", "Judge", "Word"]
