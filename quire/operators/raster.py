"""Page images: ink, lines, rules, photos and captions as numpy kernels, one image a row.

Kernels turn an image into small tables (line runs, rules, boxes); deciding what they are is done on these tables
(``quire.operators.layout``). Images never leave the worker that reads them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .layout import page_margin

# ----------------------------------------------------------------------------------------------- binary


def otsu(gray: np.ndarray) -> int:
    """Threshold that parts the grey levels with the greatest variance between the two classes."""
    return otsu_of(np.bincount(gray.ravel(), minlength=256).astype(float))


def otsu_of(h: np.ndarray) -> int:
    """``otsu`` of the number of pixels of each level."""
    n, levels = h.sum(), np.arange(256)
    w = np.cumsum(h)
    m = np.cumsum(h * levels)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / n - m) ** 2 / (w * (n - w))
    between[~np.isfinite(between)] = -1
    return int(between.argmax())


def ink(gray: np.ndarray) -> np.ndarray:
    return gray <= otsu(gray)


def dark(gray: np.ndarray, factor: float = 0.85) -> np.ndarray:
    """Ink that is clearly dark."""
    return gray < factor * otsu(gray)


def normalised(gray: np.ndarray, k: int = 15) -> np.ndarray:
    """Grey levels with the background evened out: each pixel against the least and greatest level of its neighbourhood."""
    pad = k // 2
    g = np.pad(gray, pad, mode="edge")
    win = lambda a, f, ax: f(np.lib.stride_tricks.sliding_window_view(a, k, axis=ax), axis=-1)
    lo, hi = win(win(g, np.min, 0), np.min, 1).astype(float), win(win(g, np.max, 0), np.max, 1).astype(float)
    return np.clip((gray - lo) / np.maximum(hi - lo, 1) * 255, 0, 255).astype(np.uint8)


def smooth(x: np.ndarray, k: int) -> np.ndarray:
    """Moving average of k values; beyond the ends are zeros."""
    return np.convolve(x, np.ones(k) / k, mode="same")


def runs_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true values."""
    d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(d == 1).tolist(), (np.flatnonzero(d == -1) - 1).tolist(), strict=True))


def box_sum(mask: np.ndarray, kh: int, kw: int) -> np.ndarray:
    """Number of true pixels in the kh x kw window centred on each pixel."""
    up, left = kh // 2, kw // 2
    s = np.pad(np.pad(mask.astype(np.int32), ((up, kh - 1 - up), (left, kw - 1 - left))).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return s[kh:, kw:] - s[:-kh, kw:] - s[kh:, :-kw] + s[:-kh, :-kw]


def dilate(mask: np.ndarray, kh: int, kw: int) -> np.ndarray:
    """Whether the kh x kw window centred on each pixel has a true one."""
    a = np.zeros((mask.shape[0] + kh - 1, mask.shape[1] + kw - 1), bool)
    a[kh // 2 : kh // 2 + mask.shape[0], kw // 2 : kw // 2 + mask.shape[1]] = mask
    for k, axis in ((kh, 0), (kw, 1)):
        size = 1
        while size < k:
            by = min(size, k - size)
            a = a[:-by] | a[by:] if axis == 0 else a[:, :-by] | a[:, by:]
            size += by
    return a


def close(mask: np.ndarray, k: int) -> np.ndarray:
    """Gaps narrower than k filled: dilated, then eroded (beyond the image counts as filled)."""
    return ~dilate(~dilate(mask, k, k), k, k)


def open_rows(mask: np.ndarray, least: int) -> np.ndarray:
    """Only the horizontal runs of at least ``least`` pixels."""
    out = np.zeros_like(mask)
    d = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (r0, a), (_, z) = np.nonzero(d == 1), np.nonzero(d == -1)
    for y, x0, x1 in zip(r0[z - a >= least], a[z - a >= least], z[z - a >= least], strict=True):
        out[y, x0:x1] = True
    return out


def components(mask: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Boxes (x, y, w, h, area) of 8-connected components: runs of each row are joined to those of the row above.

    ``times``: how many equal rows of the image each row of ``mask`` stands for."""
    tops = np.arange(mask.shape[0] + 1) if times is None else np.concatenate([[0], np.cumsum(times)])
    flat = np.zeros((mask.shape[0], mask.shape[1] + 1), bool)
    flat[:, :-1] = mask
    at = np.flatnonzero(np.diff(flat.ravel(), prepend=False))
    ys, xs = np.divmod(at[::2], flat.shape[1])
    xe = at[1::2] - ys * flat.shape[1]
    if not len(ys):
        return np.zeros((0, 5), np.int64)
    lab, size = np.arange(len(ys)), flat.shape[1] + 1
    below = (ys + 1) * size
    first, last = np.searchsorted(ys * size + xe, below + xs), np.searchsorted(ys * size + xs, below + xe, "right")  # touching, corners included
    n = np.maximum(last - first, 0)
    if n.any():
        a = np.repeat(lab, n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        while True:
            least, new = np.minimum(lab[a], lab[b]), lab.copy()
            for x in (a, b, lab[a], lab[b]):
                np.minimum.at(new, x, least)
            new = new[new]
            if (new == lab).all():
                break
            lab = new
        ids, lab = np.unique(lab, return_inverse=True)
        k = len(ids)
        x0, y0, x1, y1, area = np.full(k, 1 << 30), np.full(k, 1 << 30), np.zeros(k, int), np.zeros(k, int), np.zeros(k, int)
        np.minimum.at(x0, lab, xs)
        np.minimum.at(y0, lab, tops[ys])
        np.maximum.at(x1, lab, xe)
        np.maximum.at(y1, lab, tops[ys + 1])
        np.add.at(area, lab, (xe - xs) * (tops[ys + 1] - tops[ys]))
    else:
        x0, y0, x1, y1 = xs, tops[ys], xe, tops[ys + 1]
        area = (x1 - x0) * (y1 - y0)
    return np.stack([x0, y0, x1 - x0, y1 - y0, area], 1)


# ------------------------------------------------------------------------------------- equal rows told once


def packed(rows: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An image's rows and how often each stands there, equal neighbours as one. Nothing is lost: ``np.repeat`` gives the image.

    The kernels with a parameter ``times`` read this form with the same results."""
    times = np.ones(len(rows), np.int64) if times is None else times
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))
    return rows[first], np.add.reduceat(times, first)


def packed_levels(rows: np.ndarray, times: np.ndarray) -> int:
    """``otsu`` of a packed image."""
    return otsu_of(np.bincount(rows.ravel(), np.repeat(times, rows.shape[1]), 256))


def packed_close(mask: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``close`` of a packed image: within a run of equal rows, those farther from both its ends than the filling reaches are equal."""
    reach = 2 * (k // 2)
    few = np.minimum(times, 2 * reach + 1)
    n = np.ones(few.sum(), np.int64)
    long = times > few
    n[(np.cumsum(few) - few + reach)[long]] += (times - few)[long]
    return packed(close(np.repeat(mask, few, axis=0), k), n)


# ------------------------------------------------------------------------------------------------ lines


def active_columns(bw: np.ndarray, side: float = 0.06, times: np.ndarray | None = None) -> tuple[int, int]:
    """First and last column of the text band; the outermost percent never belongs to it."""
    w = bw.shape[1]
    sm = smooth(bw.mean(0) if times is None else times.astype(float) @ bw / times.sum(), max(5, w // 200))
    cols = np.flatnonzero(sm > max(0.005, sm.mean() * 0.25))
    if not len(cols):
        return int(w * side), int(w * (1 - side))
    return max(int(cols[0]), int(w * 0.01)), min(int(cols[-1]), w - 1 - int(w * 0.01))


def line_runs(bw: np.ndarray, left: int, right: int, times: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Line strips: first row, last row, share of the band's columns with ink."""
    times = np.ones(len(bw), np.int64) if times is None else times
    row = np.repeat(np.arange(len(bw)), times)
    h, band = len(row), bw[:, left : right + 1]
    k = max(3, int(round(0.004 * h)) | 1)
    least = max(3, int(round(0.0017 * h)))
    return [(a, z, float(band[row[a] : row[z] + 1].any(0).mean())) for a, z in runs_of(smooth(band.mean(1)[row], k) > 0.010) if z - a + 1 >= least]


# How far a rule's white begins at most, how many rows of it there must be, and how much ink a white row may have.
WHITE_WITHIN, WHITE_ROWS, WHITE_INK = 30, 18, 0.02


def in_white(gaps: list[tuple[int, int]], y: int, height: int) -> bool:
    """Whether row y has a run of white rows near it on both sides. ``gaps``: the page's runs of white rows; a run must have
    ``WHITE_ROWS`` rows beyond y, or half of them where the page ends with it."""
    over = [(a, min(z, y - 1)) for a, z in gaps if a < y]
    under = [(max(a, y + 1), z) for a, z in gaps if z > y]
    if not over or not under:
        return False
    (a, up), (down, z) = over[-1], under[0]
    if y - up > WHITE_WITHIN or down - y > WHITE_WITHIN:
        return False
    enough = lambda rows, edge: rows >= (WHITE_ROWS // 2 if edge else WHITE_ROWS)
    return enough(up - a + 1, a == 0) and enough(z - down + 1, z == height - 1)


def rules(bw: np.ndarray, left: int, right: int, times: np.ndarray | None = None) -> list[int]:
    """Rows of thin free-standing horizontal rules within the text band."""
    times = np.ones(len(bw), np.int64) if times is None else times
    h, band = int(times.sum()), bw[:, left : right + 1]
    w = band.shape[1]
    least, most = max(15, int(round(0.12 * w))), int(round(0.95 * w))
    length = np.repeat(open_rows(band, least).sum(1), times)
    rows = np.flatnonzero((length >= least) & (length <= most))
    if not len(rows):
        return []
    groups = np.split(rows, np.flatnonzero(np.diff(rows) > 2) + 1)
    mids = [int(g[0] + g[-1]) // 2 for g in groups if g[-1] - g[0] + 1 <= 12]
    gaps = runs_of(np.repeat(band.mean(1), times) < WHITE_INK)
    return [y for y in mids if int(0.015 * h) <= y <= int(0.985 * h) and in_white(gaps, y, h)]


def visual_crop(gray: np.ndarray, gap: int = 20, level: float = 0.004) -> tuple[int, int]:
    """Rows to cut at the top and the bottom: ink before the first wide gap within a third of the page."""
    h = len(gray)
    has = smooth((gray < 128).mean(1), 5) > level

    def first_gap(x: np.ndarray) -> int:
        at = runs_of(x)
        for (_, z), (a, _) in zip(at, at[1:], strict=False):
            if a - z - 1 >= gap:
                return a
        return 0

    top = first_gap(has[: h // 3])
    bottom = first_gap(has[::-1][: h - (h - h // 3)])
    return top, bottom


# ------------------------------------------------------------------------------------- photos, captions


def photo_boxes(bw_dark: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Components of the dark mask after closing: (x, y, w, h, area). Which are photos is decided on the table."""
    return [tuple(map(int, b)) for b in components(close(bw_dark, _photo_gap(len(bw_dark))))]


def _photo_gap(height: int) -> int:
    return max(3, int(0.0015 * height)) | 1


def packed_photo_boxes(dark_rows: np.ndarray, times: np.ndarray) -> np.ndarray:
    """``photo_boxes`` of a packed image, as rows of an array."""
    return components(*packed_close(dark_rows, times, _photo_gap(int(times.sum()))))


def line_art_boxes(bw: np.ndarray) -> list[tuple[int, int, int, int, int, float]]:
    """Components of heavily dilated ink with their true share of ink: (x, y, w, h, area, fill)."""
    k = max(3, int(0.02 * bw.shape[0]))
    return [(*map(int, b), float(bw[b[1] : b[1] + b[3], b[0] : b[0] + b[2]].mean())) for b in components(dilate(bw, k, k))]


def refine_by_border(bw: np.ndarray, box: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """The box of a drawn frame within ``box``: its outermost long lines; the box itself without a frame."""
    h, w = bw.shape
    x, y, bw_, bh = box
    rows = np.flatnonzero(open_rows(bw, max(15, int(0.06 * w))).sum(1)[y : y + bh] > 0.06 * w)
    cols = np.flatnonzero(open_rows(bw.T.copy(), max(15, int(0.06 * h))).sum(1)[x : x + bw_] > 0.06 * h)
    if len(rows) >= 2 and len(cols) >= 2:
        nx, ny, nw, nh = x + int(cols[0]), y + int(rows[0]), int(cols[-1] - cols[0]), int(rows[-1] - rows[0])
        if nw > 0 and nh > 0.10 * h:
            return nx, ny, nw, nh
    return box


def _walk(empty: np.ndarray, most: int, stop: int = 15) -> int:
    """How many of the lines beyond an edge belong to a photo: up to ``stop`` empty ones in a row, which are given back.

    The line on which the walk stops wasn't taken yet, but is given back all the same: one line of the photo with it."""
    taken = run = 0
    for e in empty[:most]:
        run = run + 1 if e else 0
        if run >= stop:
            break
        taken += 1
    return taken - run


def expand_box(box: tuple[int, int, int, int], bw: np.ndarray, share: float = 0.10) -> tuple[int, int, int, int]:
    """A photo's box grown over faint edges, side by side: top, bottom, left, right."""
    h, w = bw.shape
    x, y, bw_, bh = box
    empty = lambda a, ax: a.mean(ax) < 0.005 if a.shape[ax] else np.ones(a.shape[1 - ax], bool)
    up = _walk(empty(bw[:y, x : x + bw_][::-1], 1), int(share * h))
    y, bh = y - up, bh + up
    bh += _walk(empty(bw[y + bh :, x : x + bw_], 1), int(share * h))
    le = _walk(empty(bw[y : y + bh, :x][:, ::-1], 0), int(share * w))
    x, bw_ = x - le, bw_ + le
    bw_ += _walk(empty(bw[y : y + bh, x + bw_ :], 0), int(share * w))
    return x, y, bw_, bh


def caption_band(density: np.ndarray, lo: float = 0.005, hi: float = 0.50, white: int = 5, end: int = 35, least: int = 15, peak: float = 0.10) -> tuple[int, int] | None:
    """First band of text rows after some white, up to a long white stretch; None if none is high and dense enough."""
    text = (density > lo) & (density < hi)
    rows = np.flatnonzero(text)
    if not len(rows):
        return None
    for g in np.split(rows, np.flatnonzero(np.diff(rows) > end) + 1):
        before = 0  # rows that aren't text directly before the band's possible start
        for i in g:
            blank = i if not text[:i].any() else i - 1 - int(np.flatnonzero(text[:i])[-1])
            before = max(before, blank)
            if before >= white:
                if g[-1] - i >= least and density[i : g[-1] + 1].max() >= peak:
                    return int(i), int(g[-1]) + 1
                break
    return None


def caption_columns(bw: np.ndarray, y: int, h: int, x: int, w: int, left: int, right: int, white: int = 30) -> tuple[int, int]:
    """A caption's first column and width: the photo's columns grown to both sides until a white stretch or a bound."""
    d = bw[y : y + h].mean(0)
    x0, run = x, 0
    for k in range(x - 1, left - 1, -1):
        run = run + 1 if d[k] < 0.005 else 0
        if run >= white:
            break
        if not run:
            x0 = k
    x1, run = x + w, 0
    for k in range(x + w, right):
        run = run + 1 if d[k] < 0.005 else 0
        if run >= white:
            break
        if not run:
            x1 = k + 1
    return x0, x1 - x0


def find_caption(bw: np.ndarray, box: tuple, others: list[tuple], claimed: list[tuple], reach: int = 600) -> tuple[int, int, int, int] | None:
    """A photo's caption (x, y, w, h): below it, else above, not across a photo of its columns nor over another's caption."""
    h, w = bw.shape
    px, py, pw, ph = box
    shares = [o for o in others if max(0, min(o[0] + o[2], px + pw) - max(o[0], px)) >= 0.2 * min(o[2], pw)]
    below = min([min(h, py + ph + reach), *(o[1] for o in shares if o[1] > py + ph)])
    above = max([max(0, py - reach), *(o[1] + o[3] for o in shares if o[1] + o[3] < py), *(c[1] + c[3] for c in claimed if c[1] + c[3] <= py and min(c[0] + c[2], px + pw) > max(c[0], px))])
    for y0, y1, up in ((py + ph, below, False), (above, py, True)):
        if y1 - y0 < 20:
            continue
        d = bw[y0:y1, px : px + pw].mean(1)
        at = caption_band(d[::-1] if up else d)
        if at is None or at[1] - at[0] < 10:
            continue
        s, e = (len(d) - at[1], len(d) - at[0]) if up else at
        cy, ch = y0 + s, e - s
        beside = [o for o in others if o[1] <= cy + ch and o[1] + o[3] >= cy]
        left, right = max([0, *(o[0] + o[2] for o in beside if o[0] + o[2] <= px)]), min([w, *(o[0] for o in beside if o[0] >= px + pw)])
        cx, cw = caption_columns(bw, cy, ch, px, pw, left, right)
        if not any(cy < c[1] + c[3] and cy + ch > c[1] and cx < c[0] + c[2] and cx + cw > c[0] for c in claimed):
            return cx, cy, cw, ch
    return None


def crop(image: np.ndarray, box: tuple[int, int, int, int], pad: int = 0) -> np.ndarray:
    x, y, w, h = box
    return image[max(0, y - pad) : y + h + pad, max(0, x - pad) : x + w + pad]


# --------------------------------------------------------------------------------------------- on tables

IMAGE = "book_id string, page_no int, height int, width int, pixels binary"


def _image(r) -> np.ndarray:
    return np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width)


def page_runs(images: DataFrame) -> DataFrame:
    """Line runs of each page image: ``(book_id, page_no, height, y0, y1, width_frac)``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                bw = ink(_image(r))
                rows += [(r.book_id, r.page_no, r.height, a, z, f) for a, z, f in line_runs(bw, *active_columns(bw))]
            yield pd.DataFrame(rows, columns=["book_id", "page_no", "height", "y0", "y1", "width_frac"])

    return images.mapInPandas(each, "book_id string, page_no int, height int, y0 int, y1 int, width_frac double")


def page_rules(images: DataFrame) -> DataFrame:
    """Horizontal rules of each page image: ``(book_id, page_no, y)``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                bw = ink(_image(r))
                rows += [(r.book_id, r.page_no, y) for y in rules(bw, *active_columns(bw))]
            yield pd.DataFrame(rows, columns=["book_id", "page_no", "y"])

    return images.mapInPandas(each, "book_id string, page_no int, y int")


def page_boxes(images: DataFrame) -> DataFrame:
    """Dark components of each page image: ``(book_id, page_no, height, width, x, y, w, h, area)``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                rows += [(r.book_id, r.page_no, r.height, r.width, *box) for box in photo_boxes(dark(_image(r)))]
            yield pd.DataFrame(rows, columns=["book_id", "page_no", "height", "width", "x", "y", "w", "h", "area"])

    return images.mapInPandas(each, "book_id string, page_no int, height int, width int, x int, y int, w int, h int, area int")


def page_crops(images: DataFrame) -> DataFrame:
    """Rows to cut at the top and bottom of each page image by its first wide gaps: ``(book_id, page_no, top, bottom)``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(r.book_id, r.page_no, *visual_crop(_image(r))) for r in b.itertuples(index=False)], columns=["book_id", "page_no", "top", "bottom"])

    return images.mapInPandas(each, "book_id string, page_no int, top int, bottom int")


def page_captions(images: DataFrame) -> DataFrame:
    """Photos of each page image, grown over faint edges, with the captions found for them:
    ``(book_id, page_no, x, y, w, h, caption_x, caption_y, caption_w, caption_h)``; without a caption these are null."""
    columns = ["book_id", "page_no", "x", "y", "w", "h", "caption_x", "caption_y", "caption_w", "caption_h"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                g = _image(r)
                bw, hull = ink(g), [x[:4] for x in photo_boxes(dark(g)) if x[2] * x[3] >= 0.005 * g.size]
                boxes, claimed = [refine_by_border(bw, expand_box(x, bw)) for x in hull], []
                for x in boxes:
                    c = find_caption(bw, x, [o for o in boxes if o != x], claimed)
                    if c:
                        claimed.append(c)
                    rows.append((r.book_id, r.page_no, *map(int, x), *(map(int, c) if c else [None] * 4)))
            yield pd.DataFrame(rows, columns=columns).astype({c: "Int32" for c in columns[2:]})

    return images.mapInPandas(each, "book_id string, page_no int, " + ", ".join(f"{c} int" for c in columns[2:]))


def drawn(text: str | None, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed image of a page's text: see ``drawn_pages``."""
    lines = [x.strip() for x in (text or "").split("\n")]
    h = max(height, 16 + 17 * len(lines) + 22)
    w = max(width, 60 + max(4 * len(x) for x in lines))
    rows = np.full((2 * len(lines) + 1, w), 245, np.uint8)  # white, line, white, line ... white
    times, white = np.zeros(len(rows), np.int64), 16
    for i, s in enumerate(lines):
        if s and not s.strip("_="):
            times[2 * i], times[2 * i + 1], white = white + 4, 1, 12
            rows[2 * i + 1, 30:110] = 40
        elif s:
            times[2 * i], times[2 * i + 1], white = white, 8, 9
            rows[2 * i + 1, 30 : 30 + 4 * len(s) : 2] = 40
            rows[2 * i + 1, 30 : 30 + 4 * len(s) : 6] = 5
        else:
            white += 17
    times[-1] = h - times.sum()
    return packed(rows[times > 0], times[times > 0])


def read_drawn(pages: DataFrame, read: Callable[[str, int, np.ndarray, np.ndarray], list[tuple]], schema: str | StructType, height: int = 480, width: int = 320) -> DataFrame:
    """What ``read`` says of each page's drawn image (book_id, page_no, packed rows and their times), drawn where it is read."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [x for book, no, text in b.itertuples(index=False) for x in read(book, no, *drawn(text, height, width))]
            yield pd.DataFrame(out, columns=names, dtype=object)

    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = kind.names
    return pages.select("book_id", "page_no", "raw_text").mapInPandas(each, kind)


def box_sums(book, no, rows: np.ndarray, times: np.ndarray) -> list[tuple]:
    """Number and area of a packed image's dark components; nothing if there are none."""
    boxes = packed_photo_boxes(rows < 0.85 * packed_levels(rows, times), times)
    return [(book, no, len(boxes), int(boxes[:, 4].sum()))] if len(boxes) else []


def margin_rows(book, no, rows: np.ndarray, times: np.ndarray) -> list[tuple]:
    """``layout.page_margin`` of a packed image."""
    bw = rows <= packed_levels(rows, times)
    columns = active_columns(bw, times=times)
    out = page_margin(line_runs(bw, *columns, times), rules(bw, *columns, times), int(times.sum()))
    return [(book, no, *out)] if out else []


def drawn_pages(pages: DataFrame, height: int = 480, width: int = 320) -> DataFrame:
    """Stand-in page images: a strip for each line of text, as long as the line, a thin rule for a line of signs.

    An image is at least ``height`` by ``width``; longer pages and lines make it larger."""
    columns = ["book_id", "page_no", "height", "width", "pixels"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, held = [], 0
            for r in b.itertuples(index=False):
                g = np.repeat(*drawn(r.raw_text, height, width), axis=0)
                h, w = g.shape
                rows.append((r.book_id, r.page_no, h, w, g.tobytes()))
                held += h * w
                if held > 16_000_000:  # a batch of texts is far larger as images
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    # drawing and reading images takes time, not bytes: as many tasks as a shuffle has, not as the texts' size suggests
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.select("book_id", "page_no", "raw_text").repartition(n, "book_id", "page_no").mapInPandas(each, IMAGE)
