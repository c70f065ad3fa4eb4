"""Word shingles and weighted MinHash signatures of whole texts, in vectors over many texts at once.

The numeric part of the near-duplicate operator: what runs inside one Arrow batch.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SHINGLE = 5
_GOLD, _STEP = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)
_BASE = U(0x9E3779B97F4A7C55)  # odd, so that it has an inverse


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; the finishing step of a common counter-based generator."""
    x = x.copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    byte = np.arange(256)
    upper = (byte >= 65) & (byte <= 90)
    folded = np.where(upper, byte + 32, byte)
    word = ((folded >= 48) & (folded <= 57)) | ((folded >= 97) & (folded <= 122)) | (folded >= 128)
    return word, mix(folded.astype(U) * _GOLD + U(1))


_WORD, _VALUE = _tables()
_TIMES = mix(np.arange(1, SHINGLE + 1, dtype=U) * _STEP) | U(1)
_powers = np.ones(1, dtype=U)
_inverse = np.ones(1, dtype=U)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of them."""
    global _powers, _inverse
    if len(_powers) < n:
        steps = np.full(max(n, 1 << 20), _BASE, dtype=U)
        steps[0] = U(1)
        _powers = np.multiply.accumulate(steps)
        steps[1:] = U(pow(int(_BASE), -1, 1 << 64))
        _inverse = np.multiply.accumulate(steps)
    return _powers, _inverse


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, shingle, count)``: the different five-word shingles of every text, ordered by text.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, ``A-Z`` folded.
    A text of fewer words than five has one shingle of all its words; without words it has none.
    """
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    word = _WORD[raw]
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    powers, inverse = _grown(len(raw))
    total = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum(_VALUE[raw] * powers[: len(raw)], out=total[1:])
    words = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(U))
    owner = np.searchsorted(np.cumsum(sizes), first, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    stop = np.cumsum(n_words)
    begin = stop - n_words
    at = np.arange(len(words))
    start = (at + SHINGLE <= stop[owner]) | (at == begin[owner])
    at, owner = at[start], owner[start]
    padded = np.concatenate([words, np.zeros(SHINGLE, dtype=U)])
    made = np.zeros(len(at), dtype=U)
    for j in range(SHINGLE):
        part = padded[at + j] * _TIMES[j]
        part[at + j >= stop[owner]] = U(0)
        made += part
    made = mix(made)
    order = np.lexsort((made, owner))
    made, owner = made[order], owner[order]
    new = np.ones(len(made), dtype=bool)
    new[1:] = (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])
    place = np.flatnonzero(new)
    return owner[new], made[new], np.diff(np.append(place, len(made)))


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted MinHash by throwing darts: ``(filled, signature)`` of ``n`` sets, ``k`` values each.

    An element of weight w owns the strips 0..w-1 of height one. Every strip and every unit of time has
    its own random darts, the same in all sets, one per unit of area on average. A set sees the darts of
    its strips up to a time that shows it about ``k ln k + 2k`` of them; a hash deals each dart to one
    of ``k`` coordinates, and the earliest dart of a coordinate is its value. Two sets agree in a coordinate
    with the probability of their weighted Jaccard similarity. Sets with a coordinate left empty throw
    again up to twice the time.
    """
    best = np.full((n, k), np.iinfo(U).max, dtype=U)
    total = np.bincount(owner, weights=weight, minlength=n)
    target = k * np.log(k) + 2 * k
    until = np.divide(target, total, out=np.zeros(n), where=total > 0)
    open_sets = total > 0
    while open_sets.any():
        mine = open_sets[owner]
        best[open_sets] = np.iinfo(U).max
        _throw(owner[mine], element[mine], weight[mine], until, best, k)
        open_sets = (best == np.iinfo(U).max).any(axis=1) & (total > 0)
        until = until * 2
    return total > 0, (best & U(0xFFFFFFFF)).astype(np.uint32)


def _throw(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, until: np.ndarray, best: np.ndarray, k: int) -> None:
    strips = np.repeat(np.arange(len(element)), weight)
    strip = np.arange(len(strips)) - np.repeat(np.cumsum(weight) - weight, weight)
    seed = mix(element[strips] + strip.astype(U) * _STEP)
    who = owner[strips]
    # Units of time before the set's limit, the last one cut off.
    units = np.ceil(until[who]).astype(np.int64)
    at = np.repeat(np.arange(len(who)), units)
    unit = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
    seed, who = mix(seed[at] + unit.astype(U) * _GOLD), who[at]
    limit = np.minimum(until[who] - unit, 1.0)
    gone = np.zeros(len(seed))
    throw = 0
    flat = best.reshape(-1)
    while len(seed):
        throw += 1
        drawn = mix(seed + np.array([throw], dtype=U) * _STEP)
        gone = gone - np.log(((drawn >> U(11)).astype(np.float64) + 1.0) * 2.0**-53)
        hit = gone < limit
        seed, who, unit, limit, gone, drawn = seed[hit], who[hit], unit[hit], limit[hit], gone[hit], drawn[hit]
        dart = mix(drawn ^ _GOLD)
        time = (unit + gone).astype(np.float32).view(np.uint32).astype(U)
        place = who * k + ((dart >> U(32)) % U(k)).astype(np.int64)
        np.minimum.at(flat, place, (time << U(32)) | (dart & U(0xFFFFFFFF)))


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash per band of every signature; ``bands`` divides the signature's length."""
    rows = signature.shape[1] // bands
    parts = signature.reshape(len(signature), bands, rows).astype(U)
    out = np.broadcast_to(np.arange(bands, dtype=U) * _GOLD, parts.shape[:2]).copy()
    for j in range(rows):
        out = mix((out ^ parts[:, :, j]) * _STEP + U(j))
    return out.view(np.int64)
