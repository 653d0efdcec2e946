"""Splitting of texts into the pieces that byte-level BPE encodes one by one.

The pieces are the matches of the public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

found for all texts of a slice at once, from the class of each character.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from . import batches as B

B.ship(__name__)

OTHER, LETTER, NUMBER, SPACE = range(4)
#: The characters with the Unicode property White_Space.
WHITE = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def classes() -> np.ndarray:
    held = B.worker_cache("classes")
    if "table" not in held:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)),
                            np.uint8, 0x110000)
        table[list(WHITE)] = SPACE
        held["table"] = table
    return held["table"]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and where each begins."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead]
    points = first.astype(np.uint32)
    for least, most, tail in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF8, 3)):
        at = np.flatnonzero((first >= least) & (first < most))
        if len(at):
            value = points[at] & np.uint32(0x3F >> tail)
            for k in range(1, tail + 1):
                value = (value << np.uint32(6)) | (data[lead[at] + k] & np.uint32(0x3F))
            points[at] = value
    return points, lead


def piece_spans(texts: B.Texts) -> B.Words:
    """Byte positions of all pieces, in order; each byte of each text is in one."""
    points, lead = code_points(texts.data)
    m = len(points)
    if not m:
        none = np.zeros(0, np.int64)
        return B.Words(none, none, none)
    kind = classes()[points]
    edge = np.zeros(m + 1, bool)
    edge[np.searchsorted(lead, texts.offsets)] = True
    space = kind == SPACE
    plain = points == 32
    begins = edge[:m].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    starts = begins.copy()
    # One blank before a run of another class belongs to it ...
    starts[1:] &= ~(plain[:-1] & ~space[1:] & ~edge[1:m])
    # ... and is then no part of the white space before it.
    starts[:-1] |= space[:-1] & ~space[1:] & ~edge[1:m]
    quote = np.flatnonzero(starts & (points == 39))
    if len(quote):
        padded = np.append(points, [0, 0, 0]).astype(np.uint32)
        inner = np.append(edge, [True, True])
        one, two = padded[quote + 1], padded[quote + 2]
        near, far = ~inner[quote + 1], ~inner[quote + 2]
        pair = near & far & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))
                             | (one == ord("l")) & (two == ord("l")))
        single = near & np.isin(one, [ord(c) for c in "stmd"])
        taken = single | pair
        starts[quote[taken] + 1] = False
        after = quote[taken] + np.where(single, 2, 3)[taken]
        starts[after[after < m]] = True
    begin = lead[starts]
    end = np.append(begin[1:], len(texts.data))
    return B.Words(begin, end, np.searchsorted(texts.offsets, begin, "right") - 1)


def encoded_pieces(texts: B.Texts, known: dict[bytes, bytes], encode_new, most: int = 150_000
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the number of ids of each text.

    `known` holds the ids of pieces met before, as little-endian unsigned 32-bit
    numbers; `encode_new(pieces)` gives those of others. It is emptied when it holds
    more than `most` pieces.
    """
    spans = piece_spans(texts)
    n = len(texts.offsets) - 1
    if not len(spans.start):
        return np.zeros(0, np.uint32), np.zeros(n, np.int64)
    hashes = B.span_hashes(texts.data, spans.start, spans.end)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw = texts.data.tobytes()
    pieces = [raw[s:e] for s, e in zip(spans.start[first].tolist(), spans.end[first].tolist())]
    if len(known) > most:
        known.clear()
    new = [p for p in pieces if p not in known]
    known.update(zip(new, encode_new(new)))
    packed = [known[p] for p in pieces]
    ids = np.frombuffer(b"".join(packed), "<u4")
    length = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    begin = np.cumsum(length) - length
    return B.gathered(ids, begin[which], length[which]), B.count_by_text(spans.text, n, length[which])
