"""A trie of terms and stems, and its intersection with Levenshtein automata."""

from __future__ import annotations

import re

#: Words, also with a sign or digit in the place of a letter.
WORD = re.compile(r"[^\W_]+(?:[*@$!'’][^\W_]+)*")
#: Three or more equal letters in a row are read as one.
STRETCHED = re.compile(r"(.)\1{2,}")


def edits_allowed(term: str) -> int:
    """Longer terms bear more edits (a letter more, less, changed, or swapped with the next); short ones would meet
    ordinary words."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Trie:
    """Terms (whole words) and stems (word beginnings), each with a weight."""

    def __init__(self, entries: list[tuple[str, bool, float]]):
        self.root: dict = {}
        self.longest = 0
        for text, is_stem, weight in entries:
            node = self.root
            for ch in text:
                node = node.setdefault(ch, {})
                if not is_stem:  # how many edits the terms below bear
                    node["edits"] = max(node.get("edits", 0), edits_allowed(text))
            node["stem" if is_stem else "term"] = (text, weight)
            if not is_stem:
                self.longest = max(self.longest, len(text) + edits_allowed(text))
        # of e + 1 parts of a term, e edits leave one whole (the first, the last or one between), unless letters are swapped
        # where two parts meet: then these two stand whole with the letters swapped
        starts, middles, ends = set(), set(), set()
        for text, is_stem, _ in entries:
            if not is_stem and (e := edits_allowed(text)):
                cut = [len(text) * i // (e + 1) for i in range(e + 2)]
                parts = [re.escape(text[a:b]) for a, b in zip(cut, cut[1:])]
                starts.add(parts[0])
                ends.add(parts[-1])
                middles.update(parts[1:-1])
                for k in range(e):
                    a, b, c = cut[k : k + 3]
                    swapped = re.escape(text[a : b - 1] + text[b] + text[b - 1] + text[b + 1 : c])
                    (ends if k else starts).add(swapped)
        gates = ["^(?:" + "|".join(sorted(starts)) + ")"] * bool(starts) + ["(?:" + "|".join(sorted(middles)) + ")"] * bool(middles) + ["(?:" + "|".join(sorted(ends)) + ")$"] * bool(ends)
        self.gate = re.compile("|".join(gates)) if gates else re.compile(r"(?!)")

    def exact(self, word: str) -> tuple[str, float, int] | None:
        """The heaviest stem that the word begins with or the term that it is."""
        node, best = self.root, None
        for i, ch in enumerate(word):
            node = node.get(ch)
            if node is None:
                return best
            for kind in ("stem", "term"):
                if kind in node and (kind == "stem" or i == len(word) - 1) and (best is None or node[kind][1] > best[1]):
                    best = (*node[kind], 0)
        return best

    def near(self, word: str) -> tuple[str, float, int] | None:
        """The term with the fewest edits from the word, if it allows so many. The states of the word's Levenshtein
        automaton (letters read, edits made) run down the trie together; a state ends where no term below bears its
        edits."""
        best = None
        n, stack, seen = len(word), [(self.root, 0, 0)], set()
        while stack:
            state = stack.pop()
            node, i, edits = state
            if (key := (id(node), i, edits)) in seen:
                continue
            seen.add(key)
            if i == n and "term" in node:
                text, weight = node["term"]
                if 0 < edits <= edits_allowed(text) and (best is None or (edits, -weight, text) < (best[2], -best[1], best[0])):
                    best = (text, weight, edits)
            if i + 1 < n and (swapped := node.get(word[i + 1], {}).get(word[i])) is not None and swapped.get("edits", 0) > edits:
                stack.append((swapped, i + 2, edits + 1))
            if i < n:
                same = node.get(word[i])
                if same is not None and same.get("edits", 0) >= edits:
                    stack.append((same, i + 1, edits))
                if node is self.root or node.get("edits", 0) > edits:
                    stack.append((node, i + 1, edits + 1))  # a letter too many
            for ch, child in node.items():
                if len(ch) == 1 and child.get("edits", 0) > edits:
                    stack.append((child, i, edits + 1))  # a letter missing
                    if i < n and ch != word[i]:
                        stack.append((child, i + 1, edits + 1))  # another letter
        return best

    def match(self, word: str) -> tuple[str, float, int] | None:
        """(entry, weight, edits) of a word, or nothing."""
        found = self.exact(word)
        if found is None:
            short = STRETCHED.sub(r"\1", word)
            found = self.exact(short) if short != word else None
            if found is None and 4 <= len(short) <= self.longest and self.gate.search(short):
                found = self.near(short)
        return found
