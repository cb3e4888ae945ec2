"""Words under many rectangles of a page, found in Arrow batches by searches in sorted edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of a rectangle and a word that are tested at once.
PAIRS = 1 << 20
SEEN = pa.list_(pa.struct([("rect_id", pa.int64()), ("recovered_text", pa.string())]))


def _ranges(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each list in its values; null lists are empty."""
    at = lists.offsets.to_numpy()
    return at[:-1], np.where(lists.is_valid().to_numpy(zero_copy_only=False), at[1:], at[:-1])


def _edges(boxes: pa.StructArray) -> tuple[np.ndarray, ...]:
    """x0, y0, x1, y1 and whether all are there; as in Spark, NaN is greater than any number and equals itself."""
    columns = [boxes.field(c) for c in ("x0", "y0", "x1", "y1")]
    there = boxes.is_valid().to_numpy(zero_copy_only=False)
    for c in columns:
        there = there & c.is_valid().to_numpy(zero_copy_only=False)
    numbers = [np.asarray(c.to_numpy(zero_copy_only=False), dtype=float) for c in columns]
    return *[np.where(np.isnan(v), np.inf, v) for v in numbers], there


def _dark(rects: pa.StructArray, dark: float, min_height: float) -> np.ndarray:
    """The rectangles that could hide text, by the rules of redaction.is_dark and MIN_HEIGHT."""
    _, y0, _, y1, there = _edges(rects)
    fill = rects.field("fill")
    a, b = _ranges(fill)
    shades = np.asarray(fill.values.to_numpy(zero_copy_only=False), dtype=float)  # null as NaN, which isn't dark
    out = there & (b > a)
    for k in range(3):
        has = b - a > k
        out &= ~has | (shades[np.where(has, a + k, 0)] < dark if len(shades) else False)
    with np.errstate(invalid="ignore"):
        return out & ((y1 - y0 >= min_height) | (np.isinf(y1) & np.isinf(y0)))


def _page(words: tuple[np.ndarray, ...], rects: tuple[np.ndarray, ...], tolerance: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rectangle, word) of a page, by rectangle: the word's box lies within the rectangle, edges included.

    The words are sorted by their left and by their upper edges; a rectangle looks up those that begin within its
    width and those within its height, and tests the fewer. Boxes are well formed: left before right, upper before lower.
    """
    x0, y0, x1, y1 = words
    left, top, right, bottom = rects[0] - tolerance, rects[1] - tolerance, rects[2] + tolerance, rects[3] + tolerance
    by_x, by_y = np.argsort(x0, kind="stable"), np.argsort(y0, kind="stable")
    (ax, bx), (ay, by) = ((np.searchsorted(v, low), np.searchsorted(v, high, side="right")) for v, low, high in ((x0[by_x], left, right), (y0[by_y], top, bottom)))
    nx, ny = np.maximum(bx - ax, 0), np.maximum(by - ay, 0)
    wide = nx <= ny
    first, n = np.where(wide, ax, ay), np.where(wide, nx, ny)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        m = n[at:to]
        r = np.repeat(np.arange(at, to), m)
        place = np.arange(len(r)) - np.repeat(np.cumsum(m) - m, m) + first[r]
        w = np.where(wide[r], by_x[place], by_y[place])
        hit = (x0[w] >= left[r]) & (y0[w] >= top[r]) & (x1[w] <= right[r]) & (y1[w] <= bottom[r])
        yield r[hit], w[hit]
        at = to


def texts_under(words: pa.ListArray, rects: pa.ListArray, *, dark: float, min_height: float, tolerance: float) -> pa.ListArray:
    """For each page the dark rectangles with words under them and their texts (SEEN), in the order of the rectangles; words by index."""
    boxes, frames = words.values, rects.values
    *w_edges, w_there = _edges(boxes)
    *r_edges, _ = _edges(frames)
    idx = boxes.field("idx").to_numpy(zero_copy_only=False)
    is_text = boxes.field("text").is_valid().to_numpy(zero_copy_only=False)
    hides = _dark(frames, dark, min_height)
    empty = np.zeros(0, dtype=np.int64)
    rows, places, owners = [empty], [empty], [empty]
    for page, ((wa, wb), (ra, rb)) in enumerate(zip(zip(*_ranges(words)), zip(*_ranges(rects)))):
        ws, rs = wa + np.flatnonzero(w_there[wa:wb]), ra + np.flatnonzero(hides[ra:rb])
        if not len(ws) or not len(rs):
            continue
        for r, w in _page(tuple(e[ws] for e in w_edges), tuple(e[rs] for e in r_edges), tolerance):
            r, w = rs[r], ws[w]
            keep = is_text[w]
            r, w = r[keep], w[keep]
            order = np.lexsort((w, idx[w], r))
            rows.append(w[order])
            places.append(r[order])
            owners.append(np.full(len(r), page))
    at_word, at_rect, page_of = (np.concatenate(x) for x in (rows, places, owners))
    opens = np.flatnonzero(np.concatenate([np.ones(min(len(at_rect), 1), dtype=bool), at_rect[1:] != at_rect[:-1]]))
    texts = pa.ListArray.from_arrays(pa.array(np.append(opens, len(at_rect)), pa.int32()), boxes.field("text").take(pa.array(at_word)))
    seen = pa.StructArray.from_arrays([frames.field("rect_id").take(pa.array(at_rect[opens])), pc.binary_join(texts, " ")], fields=list(SEEN.value_type))
    counts = np.bincount(page_of[opens], minlength=len(words))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), seen)
