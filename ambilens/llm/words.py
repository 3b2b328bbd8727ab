"""Words of whole texts as numbers: split at ASCII white space, A-Z in lower case."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

END_WORD = b"\n"  # no word holds white space
END_HASH = xxhash.xxh64_intdigest(END_WORD, 0)


def dictionary() -> defaultdict:
    """Numbers words as they come; the end of a text is number 0."""
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    known[END_WORD]
    return known


def numbered(texts: Iterable[str | None], known: defaultdict) -> Iterator[np.ndarray]:
    """Word numbers of each text; a null text has none."""
    for text in texts:
        found = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
        yield np.fromiter(map(known.__getitem__, found), np.int32, len(found))


def hashes(known: defaultdict) -> np.ndarray:
    """64-bit hash of each numbered word."""
    return np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in known), np.uint64, len(known))


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes dealt anew, for uses that must not depend on each other."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))
