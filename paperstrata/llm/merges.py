"""Byte-pair merges compiled into a deterministic automaton over the letters of a pre-token.

A state stands for the letters read so far and holds the last token that the merges make of them, and how many tokens they make.
Reading a letter leads to one next state: its last token is the one token ending there that *fits* the last token of the
state where it begins; two tokens fit if no merge of a lower rank crosses the border between them while they come about, so
merging their letters together gives just the two (and no other token ending there fits as well). The step to the end of
the pre-token is the same with the tokens of word ends. So every transition is annotated with the tokens it adds, and no
transition looks at more than the longest token's letters. States are made when they are first reached, from the merges
alone.
"""

from __future__ import annotations

#: About 200 bytes each. Pre-tokens should be short: their prefixes are the states' names.
MAX_STATES = 200_000


class Merges:
    """Of a tokenizer's model whose ids are base letters, base letters at word ends, then merges by rank."""

    def __init__(self, model: dict):
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made, left, right = vocab[a + b], vocab[a], vocab[b]
            self.parts[made] = self.pairs[left, right] = made
            self.parts[made] = (left, right)
        ranked = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        base = [i for i in vocab.values() if i not in self.parts]
        if any(a >= b for a, b in zip(ranked, ranked[1:], strict=False)) or (ranked and max(base, default=-1) > ranked[0]):
            raise ValueError("ids don't follow the ranks of merges")
        self.plain = {t: i for t, i in vocab.items() if not t.endswith(end)}
        self.final = {t.removesuffix(end): i for t, i in vocab.items() if t.endswith(end)}
        self.longest = max(map(len, [*self.plain, *self.final]), default=1)
        self.states: dict[str, tuple[int, int]] = {}
        self.ends: dict[str, int] = {}
        self.whole: dict[int, bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the letters of ``a`` and ``b`` together gives ``a`` and ``b``. Walks from the border outwards through
        the parts that tokens are made of, newest first; ``limit`` is the rank at which the pair at hand was still apart."""
        pairs, parts, limit = self.pairs, self.parts, 1 << 62
        while True:
            if pairs.get((a, b), limit) < limit:
                return False
            if a > b:
                if a not in parts:
                    return True
                limit, a = a, parts[a][1]
            else:
                if b not in parts:
                    if a not in parts:
                        return True
                    limit, a = a, parts[a][1]
                else:
                    limit, b = b + 1, parts[b][0]

    def alone(self, token: int) -> bool:
        """Whether merging a token's own letters gives the token."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merged(self.letters(token)) == [token]
        return known

    def letters(self, token: int) -> list[int]:
        return [token] if token not in self.parts else [x for part in self.parts[token] for x in self.letters(part)]

    def merged(self, ids: list[int]) -> list[int]:
        """Plain merging, lowest rank first: for single tokens, and the yardstick of the automaton."""
        while len(ids) > 1:
            best = min((self.pairs.get(p, 1 << 62) for p in zip(ids, ids[1:], strict=False)))
            if best == 1 << 62:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.pairs.get((ids[i], ids[i + 1])) == best:
                    out.append(best)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _step(self, text: str, stop: int, tokens: dict[str, int]) -> tuple[int, int]:
        """The last token of text[:stop] and the number of tokens, from the states before it."""
        for begin in range(max(0, stop - self.longest), stop):
            token = tokens.get(text[begin:stop])
            if token is None:
                continue
            if not begin:
                if self.alone(token):
                    return token, 1
            else:
                last, n = self.states[text[:begin]]
                if self.fits(last, token):
                    return token, n + 1
        raise ValueError("a letter is not in the vocabulary")

    def count(self, letters: str) -> int:
        """Tokens of a pre-token, given as the model's letters."""
        known = self.ends.get(letters)
        if known is not None:
            return known
        if len(self.states) > MAX_STATES:
            self.states.clear()
        if len(self.ends) > MAX_STATES:
            self.ends.clear()
        for stop in range(1, len(letters)):
            prefix = letters[:stop]
            if prefix not in self.states:
                self.states[prefix] = self._step(letters, stop, self.plain)
        out = self.ends[letters] = self._step(letters, len(letters), self.final)[1]
        return out
