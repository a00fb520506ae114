"""NumPy kernels for whole pages or tiles, and the text detection and erasing that they make up."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pages import in_slices
from .tiles import labelled_runs


def odd(v: float) -> int:
    n = max(1, int(np.floor(v + 0.5)))
    return n + (n % 2 == 0)


def gray(rgb: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114), 0, 255).astype(np.uint8)


def window_sum(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over border-clipped (2r + 1) squares, from one table of prefix sums."""
    s = np.pad(a.astype(np.int64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    h, w = a.shape
    y0, y1 = np.clip(np.arange(h) - r, 0, h), np.clip(np.arange(h) + r + 1, 0, h)
    x0, x1 = np.clip(np.arange(w) - r, 0, w), np.clip(np.arange(w) + r + 1, 0, w)
    return s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]


def adaptive(a: np.ndarray, window: int, c: float) -> np.ndarray:
    r = min(odd(window), min(a.shape)) // 2
    high, wide = (np.clip(np.arange(n) + r + 1, 0, n) - np.clip(np.arange(n) - r, 0, n) for n in a.shape)
    return a < window_sum(a, r) / np.outer(high, wide) - c


def otsu(a: np.ndarray) -> int:
    n = np.bincount(a.ravel(), minlength=256).astype(np.float64)
    n0, s0 = n.cumsum(), (n * np.arange(256)).cumsum()
    n1, gap = n0[-1] - n0, s0 * n0[-1] - s0[-1] * n0
    between = np.where((n0 > 0) & (n1 > 0), gap * gap / np.maximum(n0 * n1, 1), 0)
    return int(between.argmax()) if between.max() > 0 else 128


def spread(mask: np.ndarray, rx: int, ry: int, inside: bool = False) -> np.ndarray:
    """Dilation by a (2 rx + 1) x (2 ry + 1) rectangle, or with ``inside`` erosion."""
    m = ~mask if inside else mask
    for axis, r in ((1, rx), (0, ry)):
        if r:
            s = np.concatenate([np.zeros_like(m[:, :1] if axis else m[:1], dtype=np.int64), m.cumsum(axis=axis)], axis=axis)
            n = m.shape[axis]
            hi, lo = np.clip(np.arange(n) + r + 1, 0, n), np.clip(np.arange(n) - r, 0, n)
            m = np.take(s, hi, axis) > np.take(s, lo, axis)
    return ~m if inside else m


def row_runs(row: np.ndarray) -> np.ndarray:
    """[x0, x1) of each run of True."""
    d = np.diff(np.concatenate([[0], row.astype(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(d == 1), np.flatnonzero(d == -1)])


def without_long_lines(mask: np.ndarray, least: int, thick: int) -> np.ndarray:
    """Long thin runs cleared: a run of ``least`` pixels goes if the stack of rows that it fills to 60 per cent is at most ``thick``."""
    out, h = mask.copy(), mask.shape[0]
    for y in range(h):
        for x0, x1 in row_runs(mask[y]):
            if x1 - x0 >= least:
                full = mask[:, x0:x1].mean(axis=1) >= 0.6
                top, end = y, y
                while top > 0 and full[top - 1] and y - top <= thick:
                    top -= 1
                while end < h - 1 and full[end + 1] and end - y <= thick:
                    end += 1
                if end - top + 1 <= thick:
                    out[y, x0:x1] = False
    return out


def components(mask: np.ndarray, raw: np.ndarray | None = None, corners: bool = True) -> list[dict]:
    """Connected components from runs and union-find, each with its ``runs`` (y, x0, x1); ink is counted on ``raw``."""
    raw, root, runs, last = mask if raw is None else raw, [], [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    reach = int(corners)
    for y in range(mask.shape[0]):
        here = []
        for x0, x1 in row_runs(mask[y]):
            i = len(runs)
            root.append(i)
            runs.append((y, int(x0), int(x1), int(raw[y, x0:x1].sum())))
            here.append(i)
            for j in last:
                if runs[j][1] < x1 + reach and x0 < runs[j][2] + reach:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        last = here
    found: dict[int, dict] = {}
    for i, (y, x0, x1, ink) in enumerate(runs):
        c = found.setdefault(find(i), {"x": x0, "y": y, "x1": x1, "y1": y + 1, "ink": 0, "area": 0, "_rows": set(), "runs": []})
        c["x"], c["x1"], c["y1"] = min(c["x"], x0), max(c["x1"], x1), y + 1
        c["ink"], c["area"] = c["ink"] + ink, c["area"] + x1 - x0
        c["runs"].append((y, x0, x1))
        if ink:
            c["_rows"].add(y)
    for c in found.values():
        c["w"], c["h"] = c.pop("x1") - c["x"], c.pop("y1") - c["y"]
        c["rows"] = len(c.pop("_rows"))
        c["row_coverage"], c["density"] = c["rows"] / c["h"], c["ink"] / (c["w"] * c["h"])
    return list(found.values())


def estimate_height(mask: np.ndarray, low: int = 4, high: int = 120) -> int:
    """Lower median of the heights of inked row bands."""
    rows = mask.sum(axis=1) >= max(2, round(0.004 * mask.shape[1]))
    heights = sorted(h for h in (int(b - a) for a, b in row_runs(rows)) if low <= h <= high)
    return min(heights[(len(heights) - 1) // 2] if heights else 12, max(low, min(mask.shape) // 16))


def fault(c: dict, glyph: float, min_h: float = 6.0, rows: bool = True) -> str | None:
    density, aspect = c["ink"] / (c["w"] * c["h"]), c["w"] / c["h"]
    cap = min(glyph * 2, 32)
    tests = (
        ("too_short", c["h"] < min_h), ("too_little_ink", c["ink"] < 3), ("density_low", density < 0.06), ("density_high", density > 0.62 and not (c["w"] <= cap and c["h"] <= cap)),
        ("too_narrow", aspect < 0.4), ("too_wide", aspect > 400), ("rows_sparse", rows and c.get("row_coverage", 1) < 0.25),
    )
    return next((name for name, bad in tests if bad), None)


def lines_of(parts: list[dict], overlap: float = 0.6, gap: float = 1.6) -> list[dict]:
    """Components on one row joined to lines; the hull grows as it takes parts in."""
    left, out = sorted(parts, key=lambda c: (c["y"], c["x"])), []
    while left:
        line = dict(left.pop(0), count=1)
        grown = True
        while grown:
            grown = False
            for c in list(left):
                over = min(line["y"] + line["h"], c["y"] + c["h"]) - max(line["y"], c["y"])
                space = max(line["x"], c["x"]) - min(line["x"] + line["w"], c["x"] + c["w"])
                if over > overlap * min(line["h"], c["h"]) and space <= gap * max(line["h"], c["h"]):
                    x, y = min(line["x"], c["x"]), min(line["y"], c["y"])
                    line |= {"w": max(line["x"] + line["w"], c["x"] + c["w"]) - x, "h": max(line["y"] + line["h"], c["y"] + c["h"]) - y, "x": x, "y": y, "ink": line["ink"] + c["ink"], "count": line["count"] + 1}
                    left.remove(c)
                    grown = True
        line["density"] = line["ink"] / (line["w"] * line["h"])
        out.append(line)
    return out


def detect(plane: np.ndarray) -> list[dict]:
    """Text lines of a gray page: threshold at two scales, solid blocks and rules removed, parts joined to lines."""
    plane = 255 - plane if (plane[::4, ::4] <= otsu(plane)).mean() > 0.6 else plane
    short = min(plane.shape)
    fine = max(15, short // 40)
    mask = adaptive(plane, fine, 10) | adaptive(plane, max(3 * fine, short // 6), 10)
    height = estimate_height(mask)
    k = odd(min(0.8 * height, short / 8)) // 2
    solid = spread(spread(mask, k, k, True), k, k)
    ink = without_long_lines(mask & ~solid, max(40, 8 * height), max(2, height // 3))
    if ink.sum() < mask.sum():
        height = estimate_height(ink)
    wide = spread(ink, odd(min(25, max(3, round(0.6 * height)))) // 2, 0)
    parts = [c for c in components(wide, ink) if fault(c, height, 3.0) is None]
    return [line for line in lines_of(parts) if fault(line, height, 6.0, False) is None]


LINE = "page long, x int, y int, w int, h int, ink long, density double, count int"


def detect_pages(pages: DataFrame) -> DataFrame:
    """Lines of pages (page, width, height, lum binary), a page a row."""
    names = [c.split()[0] for c in LINE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            planes = (np.frombuffer(raw, dtype=np.uint8).reshape(h, w) for w, h, raw in zip(b["width"], b["height"], b["lum"], strict=True))
            rows = [{"page": p} | {k: line[k] for k in names[1:]} for p, plane in zip(b["page"], planes, strict=True) for line in detect(plane)]
            yield pd.DataFrame(rows, columns=names)

    return pages.select("page", "width", "height", "lum").mapInPandas(run, LINE)


def resize(a: np.ndarray, width: float, height: float) -> np.ndarray:
    """A plane or an image at another size: the mean of what a pixel covers if either side shrinks, else bilinear."""
    (h, w), (th, tw) = a.shape[:2], (max(1, int(np.floor(height + 0.5))), max(1, int(np.floor(width + 0.5))))
    out, count = a.astype(np.float64), 1
    for axis, (n, m) in ((1, (w, tw)), (0, (h, th))):
        across = [-1 if i == axis else 1 for i in range(out.ndim)]
        if tw < w or th < h:
            lo = np.minimum(n - 1, np.floor(np.arange(m) * (n / m)).astype(int))
            hi = np.minimum(n, np.maximum(lo + 1, np.ceil((np.arange(m) + 1) * (n / m)).astype(int)))
            sums = np.concatenate([np.zeros_like(np.take(out, [0], axis)), out.cumsum(axis=axis)], axis=axis)
            out, count = np.take(sums, hi, axis) - np.take(sums, lo, axis), count * (hi - lo).reshape(across)
        else:
            at = (np.arange(m) + 0.5) * (n / m) - 0.5 if n > 1 else np.zeros(m)
            lo = np.clip(np.floor(at).astype(int), 0, n - 1)
            part = np.clip(at - lo, 0, 1).reshape(across)
            first, second = np.take(out, lo, axis), np.take(out, np.minimum(n - 1, lo + 1), axis)
            out = first + (second - first) * part
    return np.clip(np.rint(out / count), 0, 255).astype(np.uint8)


def box_mean(a: np.ndarray, r: int) -> np.ndarray:
    """Mean of the (2r + 1) square around each pixel, edges replicated."""
    wide = np.pad(a.astype(np.float64), r, mode="edge")
    s = np.pad(wide, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    n = 2 * r + 1
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / n**2


def sharpness(a: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian of a plane, on a scale from 0 to 1."""
    if min(a.shape) < 3:
        return 0.0
    p = a.astype(np.float64)
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return float(lap.var() / (lap.var() + 500))


def prepare_for_reading(plane: np.ndarray, zoom: float = 2.0, amount: float | None = None, binarise: bool = False, radius: int = 2) -> np.ndarray:
    """A plane as a reader gets it: zoomed (a quarter to four times), sharpened the more the less sharp it is, and black on white if asked."""
    zoom = min(4.0, max(0.25, zoom))
    if amount is None:
        sharp = sharpness(plane)
        amount = 0.9 if sharp < 0.35 else 0.6 if sharp < 0.6 else 0.3
    out = plane if abs(zoom - 1) <= 0.01 else resize(plane, plane.shape[1] * zoom, plane.shape[0] * zoom)
    if amount > 0:
        out = np.clip(np.rint(out + amount * (out - box_mean(out, radius))), 0, 255).astype(np.uint8)
    return np.where(adaptive(out, max(15, min(out.shape) // 40), 10), 0, 255).astype(np.uint8) if binarise else out


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Background that cannot reach the border through its four neighbours becomes ink."""
    h, w = mask.shape
    row, start, end, part = labelled_runs(~mask[None], reach=0)
    shut = np.ones(len(row) + 1, dtype=bool)
    shut[part[(row == 0) | (row == h - 1) | (start == 0) | (end == w)]] = False
    out, held = mask.copy(), shut[part]
    for y, x0, x1 in zip(row[held].tolist(), start[held].tolist(), end[held].tolist(), strict=True):
        out[y, x0:x1] = True
    return out


def inpaint(rgb: np.ndarray, mask: np.ndarray, **options) -> np.ndarray:
    return inpaint_all([rgb], [mask], **options)[0]


@lru_cache(4)
def _moves(omega: float, stop: float) -> np.ndarray:
    """Where a gray pixel moves to, by the number of its neighbours (1 to 4), its value and their sum; 256 more where all channels together move by ``stop``."""
    now, total = np.arange(256.0)[:, None], np.arange(1021.0)
    new = np.stack([now + omega * (total / n - now) for n in (1, 2, 3, 4)])
    far = np.abs(new - now)
    return (np.clip(np.rint(new), 0, 255).astype(np.int64) + 256 * (far + far + far >= stop)).ravel()


def _swept_gray(planes: list[np.ndarray], masks: list[np.ndarray], least: int, most: int, stop: float, omega: float) -> list[np.ndarray]:
    """``inpaint_all`` of images whose channels are alike, on one of them.

    Masked pixels lie together by antidiagonal and find their masked neighbours by number, the sum of the others is known. An image that is as it was
    some sweeps ago goes round for ever: what it is after ``most`` sweeps is met in less than another round.
    """
    moves, out = _moves(omega, stop), [p.copy() for p in planes]
    spots, held = [], []
    base = 1
    for i, (plane, mask) in enumerate(zip(planes, masks, strict=True)):
        h, w = mask.shape
        y, x = np.nonzero(mask)
        if not len(y) or h * w == 1:
            continue
        framed = np.zeros((h + 2, w + 2), dtype=np.int64)
        framed[1:-1, 1:-1] = plane
        if not mask.all():
            around = plane[~mask]
            framed[1:-1, 1:-1][mask] = np.partition(around, len(around) // 2)[len(around) // 2]
        number = np.zeros((h + 2, w + 2), dtype=np.int64)
        number[y + 1, x + 1] = np.arange(base, base + len(y))
        known = np.where(number > 0, 0, framed)
        sides = 4 - (y == 0) - (y == h - 1) - (x == 0) - (x == w - 1)
        near = [(y + 1, x), (y + 1, x + 2), (y, x + 1), (y + 2, x + 1)]
        spots.append(np.stack([np.full(len(y), i), y + x, framed[y + 1, x + 1], (sides - 1) * 256 * 1021 + sum(known[n] for n in near), *(number[n] for n in near)]))
        held.append(len(y))
        base += len(y)
    if not spots:
        return out
    spots = np.concatenate(spots, axis=1)
    order = np.lexsort((spots[0], spots[1]))
    place = np.zeros(base, dtype=np.int64)
    place[order + 1] = np.arange(1, base)
    owner, diag, first, known, *near = spots[:, order]
    near, at = [place[n] for n in near], order  # ``at``: the pixel of ``spots`` that is held here
    values = np.append(0, first)
    result, until = spots[2].copy(), np.full(len(planes), most - 1)
    done = np.zeros(len(planes), dtype=bool)
    snapped, seen = 0, None
    groups = None
    for k in range(most):
        if groups is None:
            ends = np.append(np.flatnonzero(np.diff(diag)) + 1, len(diag))
            groups = []
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                parts = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
                groups.append((a + 1, b + 1, known[a:b], *(n[a:b] for n in near), parts, owner[a:b][parts]))
        judged = k + 1 >= least
        far = np.zeros(len(planes), dtype=np.int64)
        for a, b, base_, n1, n2, n3, n4, parts, own in groups if k % 2 == 0 else reversed(groups):
            index = values[a:b] * 1021
            index += base_
            for n in (n1, n2, n3, n4):
                index += values.take(n)
            new = moves.take(index)
            if judged:
                far[own] = np.maximum(far[own], np.maximum.reduceat(new, parts))
            values[a:b] = new & 255
        if not judged and k < most - 1:
            continue
        now = values[1:]
        live = ~done
        ended = live & ((far < 256) | (until <= k))
        if seen is not None and (k - snapped) % 2 == 0:
            same = np.ones(len(planes), dtype=bool)
            same[owner[now != seen]] = False
            same &= live & (until == most - 1)
            until[same] = k + (most - 1 - k) % (k - snapped)
            ended |= live & (until <= k)
        if k == most - 1:
            ended = live
        if ended.any():
            mine = ended[owner]
            result[at[mine]] = now[mine]
            done |= ended
            keep = ~done[owner]
            if not keep.any():
                break
            if keep.mean() < 0.8:  # images that are done are swept on until it pays to drop them
                fresh = np.zeros(len(owner) + 1, dtype=np.int64)
                fresh[1:][keep] = np.arange(1, keep.sum() + 1)
                owner, diag, known, at, near = owner[keep], diag[keep], known[keep], at[keep], [fresh[n[keep]] for n in near]
                values = np.append(0, now[keep])
                seen = seen[keep] if seen is not None else None
                groups = None
        if seen is None or k - snapped >= max(2, snapped // 2):
            snapped, seen = k, values[1:].copy()
    start = 0
    for i, count in zip([int(o) for o in spots[0][np.cumsum(held) - 1]], held, strict=True):
        out[i][masks[i]] = result[start : start + count]
        start += count
    return out


def inpaint_all(images: list[np.ndarray], masks: list[np.ndarray], least: int = 16, most: int = 600, stop: float = 1.2, omega: float = 1.85) -> list[np.ndarray]:
    """Masked pixels over-relaxed towards the mean of their neighbours, seeded with the upper median outside.

    Sweeps go pixel by pixel in reading order and back in turn, in whole numbers, until no pixel would move by ``stop`` (channels
    summed). The result hangs on that order, and the order only on neighbours: pixels on one antidiagonal never touch, those
    above and on the left lie on the one before. So each sweep takes whole antidiagonals, of all images that still move at once.
    """
    gray = [i for i, rgb in enumerate(images) if rgb.dtype == np.uint8 and (rgb[..., :1] == rgb).all()]
    alike = dict(zip(gray, _swept_gray([images[i][..., 0] for i in gray], [masks[i] for i in gray], least, most, stop, omega), strict=True))
    rest = [i for i in range(len(images)) if i not in alike]
    others = dict(zip(rest, _swept([images[i] for i in rest], [masks[i] for i in rest], least, most, stop, omega), strict=True))
    return [np.repeat(alike[i][..., None], 3, axis=2) if i in alike else others[i] for i in range(len(images))]


def _swept(images: list[np.ndarray], masks: list[np.ndarray], least: int, most: int, stop: float, omega: float) -> list[np.ndarray]:
    """``inpaint_all`` of images of any colours."""
    out, flat, stride, base, place, owner, diag, sides = [], [], [], 0, [], [], [], []
    for i, (rgb, mask) in enumerate(zip(images, masks, strict=True)):
        h, w = mask.shape
        framed = np.zeros((h + 2, w + 2, 3), dtype=np.float64)
        framed[1:-1, 1:-1] = rgb
        if mask.any() and not mask.all():
            around = np.sort(rgb[~mask], axis=0)
            framed[1:-1, 1:-1][mask] = around[len(around) // 2]
        y, x = np.nonzero(mask)
        place.append(base + (y + 1) * (w + 2) + x + 1)
        owner.append(np.full(len(y), i))
        stride.append(np.full(len(y), w + 2))
        diag.append(y + x)
        sides.append(4 - (y == 0) - (y == h - 1) - (x == 0) - (x == w - 1))
        flat.append(framed.reshape(-1, 3))
        base += framed.shape[0] * framed.shape[1]
    pixels = np.concatenate(flat) if flat else np.zeros((0, 3))
    place, owner, stride, diag, sides = (np.concatenate(a) if a else np.zeros(0, dtype=int) for a in (place, owner, stride, diag, sides))
    moving = np.flatnonzero(sides > 0)
    moving = moving[np.argsort(diag[moving], kind="stable")]
    delta, groups, states = np.zeros(len(images)), None, []
    for k in range(most):
        if not len(moving):
            break
        if groups is None:
            groups = []
            for g in np.split(moving, np.flatnonzero(np.diff(diag[moving])) + 1):
                first = np.flatnonzero(np.diff(owner[g], prepend=-1))
                groups.append((place[g], stride[g], sides[g, None], first, owner[g][first]))
        delta[:] = 0
        for at, up, n, first, own in groups if k % 2 == 0 else reversed(groups):
            now = pixels[at]
            new = now + omega * ((pixels[at - 1] + pixels[at + 1] + pixels[at - up] + pixels[at + up]) / n - now)
            if k + 1 >= least:
                delta[own] = np.maximum(delta[own], np.maximum.reduceat(np.abs(new - now).sum(axis=1), first))
            pixels[at] = np.clip(np.rint(new), 0, 255)
        if k + 1 < least:
            continue
        ended = delta < stop
        states = [*states[-2:], pixels[place]]
        if len(states) == 3 and (most - 1 - k) % 2 == 0:
            # As it was two sweeps ago, and neither stopped it: so it goes on for ever, and this is what the last sweep leaves.
            changed = np.zeros(len(images), dtype=bool)
            changed[owner[(states[2] != states[0]).any(axis=1)]] = True
            ended |= ~changed
        if ended[owner[moving]].any():
            moving, groups = moving[~ended[owner[moving]]], None
    start = 0
    for mask in masks:
        h, w = mask.shape
        out.append(pixels[start : start + (h + 2) * (w + 2)].reshape(h + 2, w + 2, 3)[1:-1, 1:-1].astype(np.uint8))
        start += (h + 2) * (w + 2)
    return out


def text_mask(plane: np.ndarray, grow: int = 2) -> np.ndarray:
    """Strokes of a text box: adaptive threshold, holes filled, rules and blocks dropped, grown by ``grow``."""
    window = odd(min(max(9, min(plane.shape) // 6), min(plane.shape)))
    dark = np.median(plane) < 95
    mask = fill_holes(adaptive(255 - plane if dark else plane, window, 8))
    glyph, keep = estimate_height(mask), np.zeros_like(mask)
    row, start, end, part = labelled_runs(mask[None], reach=0)
    if not len(row):
        return spread(keep, grow, grow)
    order = np.argsort(part, kind="stable")
    first = np.flatnonzero(np.diff(part[order], prepend=-1))
    fold = lambda how, v: how.reduceat(v[order], first)
    w, h, area = fold(np.maximum, end) - fold(np.minimum, start), fold(np.maximum, row) - fold(np.minimum, row) + 1, fold(np.add, end - start)
    long, short = np.maximum(w, h), np.minimum(w, h)
    rule = ((long / short >= 8) & (area / (w * h) >= 0.7)) | ((short <= 2) & (long / short >= 5))
    kept = (~rule & (h <= 3 * glyph + 2) & (area <= 24 * glyph * glyph))[part]
    for y, x0, x1 in zip(row[kept].tolist(), start[kept].tolist(), end[kept].tolist(), strict=True):
        keep[y, x0:x1] = True
    return spread(keep, grow, grow)


def erase_text(rgb: np.ndarray) -> np.ndarray:
    return inpaint(rgb, text_mask(gray(rgb)))


#: Bytes of page images that are swept together.
TOGETHER = 4 << 20


def erase_pages(pages: DataFrame) -> DataFrame:
    """Pages (page, width, height, rgb binary) with their text painted over; ``left`` is the share of masked pixels."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        images = [np.frombuffer(raw, dtype=np.uint8).reshape(h, w, 3) for w, h, raw in zip(part["width"], part["height"], part["rgb"], strict=True)]
        masks = [text_mask(gray(i)) for i in images]
        done = inpaint_all(images, masks)
        return part[["page", "width", "height"]].assign(rgb=[d.tobytes() for d in done], masked=[float(m.mean()) for m in masks])

    return in_slices(pages.select("page", "width", "height", "rgb"), "rgb", work, "page long, width int, height int, rgb binary, masked double", TOGETHER)


def thin_bands(full: np.ndarray, thick: int = 6, share: float = 0.4) -> np.ndarray:
    """Marks runs of full rows (or columns) of at most ``thick``, from the first on, while they stay under ``share`` of the extent."""
    out, left = np.zeros_like(full), max(1, int(np.floor(len(full) * share + 0.5)))
    for a, b in row_runs(full):
        if b - a <= min(thick, left):
            out[a:b] = True
            left -= b - a
    return out


def ring_colour(rgb: np.ndarray, box: tuple[int, int, int, int], width: int = 6, step: int = 16) -> tuple[np.ndarray, float]:
    """Mean colour of the fullest colour bucket around a box (x0, y0, x1, y1), and that bucket's share of the ring."""
    x0, y0, x1, y1 = box
    outside = np.ones(rgb.shape[:2], dtype=bool)
    outside[y0:y1, x0:x1] = False
    area = (slice(max(0, y0 - width), y1 + width), slice(max(0, x0 - width), x1 + width))
    pixels = rgb[area][outside[area]].astype(np.int64)
    if not len(pixels):
        return np.array([255, 255, 255]), 0.0
    _, first, bucket, n = np.unique(pixels // step @ np.array([65536, 256, 1]), return_index=True, return_inverse=True, return_counts=True)
    best = np.lexsort((first, -n))[0]
    return np.floor(pixels[bucket == best].mean(axis=0) + 0.5).astype(np.int64), float(n[best] / len(pixels))


COVER = ("mode", "coverage", "threshold", "painted", "residual", "protected")


def cover(rgb: np.ndarray, x: float, y: float, w: float, h: float, mode: str = "ink", glyph: float = 0.0) -> tuple[np.ndarray, dict]:
    """The page with the text of one box painted over, and what was done.

    ``fill`` paints the whole box in the colour around it, unless that colour has less than 55 per cent of the ring: then ``ink``.
    ``ink`` paints pixels unlike that colour and their soft edges, sparing rules, strips and pictures. ``repair`` relaxes the strokes
    from their surroundings. Boxes under 3 pixels, and repairs that find no strokes, leave the page as it is (mode null).
    """
    high, wide = rgb.shape[:2]
    x0, y0 = min(max(0, int(np.floor(x))), wide), min(max(0, int(np.floor(y))), high)
    x1, y1 = min(int(np.ceil(x + w)), wide), min(int(np.ceil(y + h)), high)
    done = dict.fromkeys(COVER) | {"painted": 0}
    if x1 - x0 < 3 or y1 - y0 < 3:
        return rgb, done
    colour, share = ring_colour(rgb, (x0, y0, x1, y1))
    out = rgb.copy()
    inner = out[y0:y1, x0:x1]
    done["coverage"] = share
    if mode == "repair":
        strokes = text_mask(gray(inner))
        if strokes.mean() < 0.004:
            return rgb, done
        whole = np.zeros(rgb.shape[:2], dtype=bool)
        whole[y0:y1, x0:x1] = strokes
        area = (slice(max(0, y0 - 6), y1 + 6), slice(max(0, x0 - 6), x1 + 6))
        out[area] = inpaint(rgb[area], whole[area])
        return out, done | {"mode": "repair", "painted": int(strokes.sum())}
    if mode == "fill" and share >= 0.55:
        inner[:] = colour
        return out, done | {"mode": "fill", "painted": inner.shape[0] * inner.shape[1]}
    far = np.floor(np.sqrt(((inner.astype(np.int64) - colour) ** 2).sum(axis=2)) + 0.5)
    threshold = 16 if share >= 0.8 else 30 if share >= 0.55 else 44
    ink = far > threshold
    rows, cols = thin_bands(ink.mean(axis=1) >= 0.85), thin_bands(ink.mean(axis=0) >= 0.85)
    spared = rows[:, None] | cols[None, :]
    parts = components(ink, corners=False)
    glyph = glyph or (sorted(c["h"] for c in parts)[len(parts) // 2] if parts else 0)
    for c in parts:
        if rows[c["y"]] and rows[c["y"] + c["h"] - 1]:
            continue
        solid = c["area"] / (c["w"] * c["h"]) >= 0.85
        strip = solid and min(c["w"], c["h"]) <= 4 and max(c["w"], c["h"]) >= max(24, 3 * glyph)
        if c["h"] > max(18, 4 * glyph + 8) or strip:
            for r, a, b in c["runs"]:
                spared[r, a:b] = True
    erase, soft = ink & ~spared, (far > max(14, int(np.floor(threshold * 0.4 + 0.5)))) & ~spared
    for _ in range(2):
        erase = erase | ((spread(erase, 1, 0) | spread(erase, 0, 1)) & soft)
    inner[erase] = colour
    return out, done | {"mode": "ink", "threshold": threshold, "painted": int(erase.sum()), "residual": int(((far > 22) & ~erase & ~spared).sum()), "protected": int((spared & ink).sum())}


def cover_pages(pages: DataFrame, boxes: DataFrame, mode: str = "ink") -> DataFrame:
    """Pages (page, width, height, rgb) with all their ``boxes`` (page, no, x, y, w, h) covered in order, and a report for each box.

    A page's boxes come to its image as one list, so an image is moved once.
    """
    listed = boxes.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("no", "x", "y", "w", "h"))).alias("boxes"))
    none = F.array().cast(listed.schema["boxes"].dataType)

    def work(b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for page, w, h, raw, todo in zip(b["page"], b["width"], b["height"], b["rgb"], b["boxes"], strict=True):
            image, report = np.frombuffer(raw, dtype=np.uint8).reshape(h, w, 3), []
            for t in todo:
                image, done = cover(image, t["x"], t["y"], t["w"], t["h"], mode)
                report.append({"no": t["no"]} | done)
            rows.append((page, w, h, image.tobytes(), report))
        return pd.DataFrame(rows, columns=["page", "width", "height", "rgb", "report"])

    joined = pages.select("page", "width", "height", "rgb").join(listed, "page", "left").withColumn("boxes", F.coalesce("boxes", none))
    return in_slices(joined, "rgb", work, "page long, width int, height int, rgb binary, report array<struct<no:int,mode:string,coverage:double,threshold:int,painted:int,residual:int,protected:int>>", TOGETHER)
