"""A minimal acyclic transducer from words to id sequences.

Words in byte order are added one by one; as soon as a state can get no more arcs it is merged with an equal one, so
suffixes are shared. Each arc carries the number of words that come before those it leads to: the sum along a path is
the word's number, under which its ids stand. All parts are flat arrays in one file that is memory-mapped, and words
are looked up together, one array step per byte."""

from __future__ import annotations

import json

import numpy as np


def build(words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the transducer of distinct, sorted, non-empty ``words``; ``ids`` of all words in turn, ``sizes`` of each."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}

    def minimise(path: list[tuple[int, int]], down_to: int) -> None:
        while len(path) > down_to:
            state, byte = path.pop()
            child = arcs[state][byte]
            shape = (final[child], tuple(arcs[child].items()))
            arcs[state][byte] = known.setdefault(shape, child)

    path: list[tuple[int, int]] = []
    before = b""
    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(word, before)) if a != b), min(len(word), len(before)))
        minimise(path, shared)
        state = arcs[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[shared:]:
            arcs.append({})
            final.append(False)
            arcs[state][byte] = len(arcs) - 1
            path.append((state, byte))
            state = len(arcs) - 1
        final[state] = True
        before = word
    minimise(path, 0)

    below: dict[int, int] = {}  # words that can be completed from a state
    order = [0]
    while order:  # children first, without recursion
        state = order[-1]
        todo = [child for child in arcs[state].values() if child not in below]
        if todo:
            order += todo
            continue
        order.pop()
        below[state] = final[state] + sum(below[child] for child in arcs[state].values())
    number = {state: n for n, state in enumerate(sorted(below))}  # the states that are left
    rows = []
    for state in number:
        skip = int(final[state])
        for byte, child in sorted(arcs[state].items()):
            rows.append((number[state] * 256 + byte, number[child], skip))
            skip += below[child]
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return {
        "arc_from": table[:, 0].copy(), "arc_to": table[:, 1].astype(np.int32), "arc_skip": table[:, 2].astype(np.int32),
        "final": np.array([final[state] for state in number], np.uint8),
        "id_starts": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
        "ids": np.asarray(ids, np.int32),
    }


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """All arrays in one block: a line that names them, then their bytes, each at a multiple of eight."""
    places, parts, at = {}, [], 0
    for name, array in arrays.items():
        raw = array.tobytes()
        places[name] = (array.dtype.str, len(array), at)
        raw += b"\0" * (-len(raw) % 8)
        parts.append(raw)
        at += len(raw)
    head = json.dumps(places).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + b"".join(parts)


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a packed file, as views of the mapped file."""
    whole = np.asarray(np.memmap(path, np.uint8, "r"))
    with open(path, "rb") as file:
        head = file.readline()
    return {name: whole[len(head) + at:len(head) + at + np.dtype(kind).itemsize * n].view(kind) for name, (kind, n, at) in json.loads(head).items()}


def lookup(arrays: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """The number of each word, -1 for those that are not in the lexicon."""
    found = np.full(len(words), -1, np.int64)
    if not words or not len(arrays["arc_from"]):
        return found
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    state = np.zeros(len(words), np.int64)
    number = np.zeros(len(words), np.int64)
    alive = np.nonzero(lengths > 0)[0]
    step = 0
    while len(alive):
        wanted = state[alive] * 256 + letters[starts[alive] + step]
        arc = np.minimum(np.searchsorted(arrays["arc_from"], wanted), len(arrays["arc_from"]) - 1)
        fits = arrays["arc_from"][arc] == wanted
        alive, arc = alive[fits], arc[fits]
        state[alive] = arrays["arc_to"][arc]
        number[alive] += arrays["arc_skip"][arc]
        step += 1
        ended = lengths[alive] == step
        done = alive[ended]
        done = done[arrays["final"][state[done]] == 1]
        found[done] = number[done]
        alive = alive[~ended]
    return found
