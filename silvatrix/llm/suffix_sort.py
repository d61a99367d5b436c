"""Deep-shallow suffix sorting over one text buffer.

Suffixes are first ordered to a shallow depth by multikey quicksort, which
splits on one word of bytes at a time. The groups that agree to that depth
have long common prefixes; comparing them byte by byte over and over would be
slow, so each is put into a blind trie. A blind trie keeps only branching
depths and bytes: an insertion walks down without looking at the text, does a
single comparison with the leaf it reaches, and hangs the new leaf at the
depth that this comparison found. Reading the trie in order gives the sorted
suffixes together with the common prefixes of neighbours.
"""

from __future__ import annotations

#: Bytes that multikey quicksort takes at a time, and the depth where it stops.
WORD = 8
SHALLOW = 24


def common_prefix(buf: bytes, a: int, a_end: int, b: int, b_end: int, known: int = 0) -> int:
    """Length of the common prefix of buf[a:a_end] and buf[b:b_end], which agree on ``known`` bytes."""
    most = min(a_end - a, b_end - b)
    at, step = known, 64
    while at < most:
        n = min(step, most - at)
        x, y = buf[a + at : a + at + n], buf[b + at : b + at + n]
        if x != y:
            differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return at + n - (differ.bit_length() + 7) // 8
        at += n
        step *= 4
    return most


class BlindTrie:
    """Sorts suffixes that agree on ``known`` bytes; equal suffixes share a leaf.

    An inner node is ``[depth, {byte: child}]``, where byte -1 is the end of a
    suffix; a leaf is ``(start, end, names)``.
    """

    def __init__(self, buf: bytes, known: int):
        self.buf, self.known, self.root = buf, known, None

    def _byte(self, start: int, end: int, depth: int) -> int:
        return self.buf[start + depth] if start + depth < end else -1

    def insert(self, start: int, end: int, name: int) -> None:
        if self.root is None:
            self.root = (start, end, [name])
            return
        node, path = self.root, []
        while type(node) is list:
            byte = self._byte(start, end, node[0])
            path.append((node, byte))
            node = node[1].get(byte) or next(iter(node[1].values()))  # any leaf below will do
        depth = common_prefix(self.buf, start, end, node[0], node[1], self.known)
        if depth == end - start == node[1] - node[0]:
            node[2].append(name)
            return
        leaf, above = (start, end, [name]), None
        for inner, byte in path:
            if inner[0] == depth:
                inner[1][byte] = leaf
                return
            if inner[0] > depth:
                break
            above = inner[1], byte
        below = self.root if above is None else above[0][above[1]]
        split = [depth, {self._byte(node[0], node[1], depth): below, self._byte(start, end, depth): leaf}]
        if above is None:
            self.root = split
        else:
            above[0][above[1]] = split

    def ordered(self) -> list[tuple[int, int]]:
        """(name, common prefix with the one before) in suffix order; the first has 0."""
        out: list[tuple[int, int]] = []
        todo = [(self.root, 0)]
        while todo:
            node, lcp = todo.pop()
            if type(node) is tuple:
                out.append((node[2][0], lcp))
                out += [(name, node[1] - node[0]) for name in node[2][1:]]
                continue
            kids = [node[1][b] for b in sorted(node[1])]
            todo += [(kid, node[0]) for kid in kids[:0:-1]]
            todo.append((kids[0], lcp))
        return out


def _shared(x: bytes, y: bytes) -> int:
    return common_prefix(x + y, 0, len(x), len(x), len(x) + len(y))


def deep_shallow_sort(buf: bytes, starts: list[int], ends: list[int], known: int = 0) -> tuple[list[int], list[int]]:
    """Order of the suffixes buf[starts[i]:ends[i]] and each one's common prefix with the one before.

    All of them agree on their first ``known`` bytes. A suffix that is a prefix
    of another comes before it; of equal ones the order is not defined.
    """
    order: list[int] = []
    lcps: list[int] = []
    limit = known + SHALLOW
    todo = [(list(range(len(starts))), known, 0)] if starts else []
    while todo:
        group, depth, before = todo.pop()
        if len(group) == 1:
            order.append(group[0])
            lcps.append(before)
            continue
        if depth >= limit:
            trie = BlindTrie(buf, depth)
            for i in group:
                trie.insert(starts[i], ends[i], i)
            found = trie.ordered()
            order += [i for i, _ in found]
            lcps += [before, *(lcp for _, lcp in found[1:])]
            continue
        words = [buf[starts[i] + depth : min(starts[i] + depth + WORD, ends[i])] for i in group]
        pivot = words[len(words) // 2]
        low = [i for i, w in zip(group, words) if w < pivot]
        same = [i for i, w in zip(group, words) if w == pivot]
        high = [i for i, w in zip(group, words) if w > pivot]
        # Where two parts meet, the nearest words of both sides tell the common prefix.
        to_high = depth + _shared(pivot, min(w for w in words if w > pivot)) if high else 0
        to_same = depth + _shared(max(w for w in words if w < pivot), pivot) if low else before
        if high:
            todo.append((high, depth, to_high))
        todo.append((same, depth + WORD if len(pivot) == WORD else limit, to_same))
        if low:
            todo.append((low, depth, before))
    return order, lcps
