"""Byte-pair encoding by prefix dynamic programming.

A sequence of tokens is what byte-pair encoding makes of its text exactly if each token is made of its own text and
each two neighbours are made of theirs. So every prefix has one valid last token: the vocabulary entry t that ends
the prefix and fits the last token of the prefix without t. One pass stores it, and the token count, for each
prefix: counts of all prefixes, appends and re-encoding from an edit on come without encoding anything again.

Two tokens fit if no merge crosses their border while they are built. Each was built by a chain of merges at the
border (its spine); border tokens x, y stand side by side until either is absorbed, and x + y would be merged
before that if its rank is lower (the leftmost of equal merges goes first).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

#: Entries of a worker's cache; a full one takes no more (frequent words come early). Longer words aren't kept.
CACHE, CACHED_LENGTH = 800_000, 48


class PrefixBPE:
    """ranks: token (str or bytes) -> merge rank; base units needn't be in it (they then are tokens of their own)."""

    def __init__(self, ranks: dict, mergeable=None):
        self.ranks = ranks
        self._merge = {t: r for t, r in ranks.items() if len(t) > 1} if mergeable is None else mergeable
        self._spines: dict = {}
        self._fits: dict = {}
        longest: dict = {}
        for t in self._merge:
            longest[t[-1:]] = max(longest.get(t[-1:], 1), len(t))
        self._longest = longest

    def merged(self, data) -> list:
        """The tokens of data by merging step by step: for short pieces, and to build spines."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            best = min(((self._merge[p + q], i) for i, (p, q) in enumerate(zip(parts, parts[1:], strict=False)) if p + q in self._merge), default=None)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _spine(self, token):
        """(right spine, left spine) as [(token, rank at which it is absorbed)], None for a token that is never made,
        or False where ranks don't rise along the merges."""
        s = self._spines.get(token)
        if s is None and token not in self._spines:
            parts, right, left, ranks, rising = [token[i : i + 1] for i in range(len(token))], [], [], [], True
            while len(parts) > 1:
                best = min(((self._merge[p + q], i) for i, (p, q) in enumerate(zip(parts, parts[1:], strict=False)) if p + q in self._merge), default=None)
                if best is None:
                    break
                rank, i = best
                rising = rising and (not ranks or rank >= ranks[-1])
                ranks.append(rank)
                if i + 2 == len(parts):
                    right.append((parts[-1], rank))
                if i == 0:
                    left.append((parts[0], rank))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            never = float("inf")
            s = None if len(parts) > 1 else (([*right, (token, never)], [*left, (token, never)]) if rising else False)
            self._spines[token] = s
        return s

    def fits(self, a, b) -> bool:
        key = (a, b)
        known = self._fits.get(key)
        if known is None:
            sa, sb = self._spine(a), self._spine(b)
            if sa is None or sb is None:
                known = False
            elif sa is False or sb is False:
                known = self.merged(a + b) == [a, b]
            else:
                known = self._side_by_side(sa[0], sb[1])
            if len(self._fits) < CACHE:
                self._fits[key] = known
        return known

    def _side_by_side(self, xs: list, ys: list) -> bool:
        i = j = 0
        merge = self._merge
        while True:
            (x, gone_x), (y, gone_y) = xs[i], ys[j]
            rank = merge.get(x + y)
            if rank is not None and rank < gone_x and rank <= gone_y:
                return False
            if i + 1 == len(xs) and j + 1 == len(ys):
                return True
            if gone_x <= gone_y:
                i += 1
            else:
                j += 1

    def last_tokens(self, data, known: Sequence = ()) -> list:
        """Each prefix's valid last token, for lengths 1, 2, ...; known: those of a prefix that is done already."""
        last = list(known)
        longest, merge, pairs, fits = self._longest, self._merge, self._fits, self.fits
        for i in range(len(last) + 1, len(data) + 1):
            most = longest.get(data[i - 1 : i], 1)
            for n in range(min(i - 1, most), 1, -1):
                t = data[i - n : i]
                if t in merge:
                    before = last[i - n - 1]
                    ok = pairs.get((before, t))
                    if ok or ok is None and fits(before, t):
                        break
            else:  # no token that something stands before: one that starts the text, or a single unit
                t = data[i - 1 : i]
                if 1 < i <= most and (whole := data[:i]) in merge and self._spine(whole) is not None:
                    t = whole
            last.append(t)
        return last

    def last_tokens_again(self, data, start: int, behind: int, old: Sequence) -> list:
        """The prefixes' last tokens after data[start:behind] was put in place of something; old: those from before.

        A prefix's last token follows from as many characters, and last tokens, before it as the longest token has. So
        where that many in a row, all behind the edit, are those of the old text again, all others are too."""
        shift, step = len(data) - len(old), max(self._longest.values(), default=1)
        last = self.last_tokens(data[:behind], old[:start])
        while len(last) < len(data):
            n = len(last)
            upto = min(len(data), n + step)
            last = self.last_tokens(data[:upto], last)
            # near its beginning a text has tokens that nothing stands before
            if upto - n >= step <= min(n, n - shift) and last[n:upto] == old[n - shift : upto - shift]:
                return last + list(old[upto - shift :])
            step = max(step, n // 8)  # so that tables are copied a few times only
        return last

    def tables(self, words: Iterable) -> Iterator[tuple]:
        """(word, number of prefixes shared with the word before, its last tokens) of words, in sorted order: each
        table starts from the prefixes it shares with the one before."""
        before, last = None, []
        for w in sorted(words):
            n = 0
            if before is not None:
                most = min(len(w), len(before))
                if w[:most] == before[:most]:
                    n = most
                else:
                    while w[n] == before[n]:
                        n += 1
            last = self.last_tokens(w, last[:n])
            yield w, n, last
            before = w

    @staticmethod
    def walk(last: Sequence, end: int | None = None) -> list:
        """The tokens of the prefix of length end (all by default)."""
        out, i = [], len(last) if end is None else end
        while i:
            out.append(last[i - 1])
            i -= len(last[i - 1])
        return out[::-1]


class PrefixEncoding:
    """The encoding of one piece that can grow and be edited: each prefix's last token is kept."""

    def __init__(self, bpe: PrefixBPE, data=b""):
        self.bpe, self.data, self.last = bpe, data, bpe.last_tokens(data)

    def append(self, more) -> PrefixEncoding:
        self.data += more
        self.last = self.bpe.last_tokens(self.data, self.last)
        return self

    def replace(self, start: int, end: int, new) -> PrefixEncoding:
        """Put new in place of data[start:end]; from there on it is encoded again until it meets the old encoding."""
        self.data = self.data[:start] + new + self.data[end:]
        self.last = self.bpe.last_tokens_again(self.data, start, start + len(new), self.last)
        return self

    def tokens(self, end: int | None = None) -> list:
        return self.bpe.walk(self.last, end)
