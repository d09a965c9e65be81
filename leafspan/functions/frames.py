"""Frames and margins of page images (height x width x 3 arrays), for pandas UDFs.

These rules walk from an edge inwards with state, or follow connected pixels, which
column expressions cannot say.
"""

from __future__ import annotations

import numpy as np

TOLERANCE, OCCUPANCY, EDGE = 12, 0.005, 2
SOFT_CHROMA, UNIFORM, UNIFORM_SHARE = 15, 20, 0.85


def over_white(rgba: np.ndarray) -> np.ndarray:
    """Colours of an image with alpha on white."""
    if rgba.shape[2] == 3:
        return rgba.astype(np.int16)
    alpha = rgba[:, :, 3:].astype(np.float64) / 255
    return np.rint(rgba[:, :, :3] * alpha + 255 * (1 - alpha)).astype(np.int16)


def chroma(rgb: np.ndarray) -> np.ndarray:
    return rgb.max(axis=-1) - rgb.min(axis=-1)


def content_box(rgb: np.ndarray, tolerance: int = TOLERANCE, occupancy: float = OCCUPANCY) -> tuple[int, int, int, int] | None:
    """Inclusive (left, top, right, bottom) of the rows and columns that differ from the edge colour."""
    edge = np.concatenate([part.reshape(-1, 3) for part in (rgb[:EDGE], rgb[-EDGE:], rgb[:, :EDGE], rgb[:, -EDGE:])])
    differs = np.abs(rgb - np.median(edge, axis=0)).max(axis=2) > tolerance
    rows, columns = (np.flatnonzero(differs.mean(axis=axis) > occupancy) for axis in (1, 0))
    if not len(rows) or not len(columns):
        return None
    return int(columns[0]), int(rows[0]), int(columns[-1]), int(rows[-1])


def trim_box(rgb: np.ndarray, pad: int = 8, least: float = 0.25) -> tuple[int, int, int, int]:
    """Half-open box that keeps the content and a margin; the whole image if too little would be left."""
    height, width = rgb.shape[:2]
    whole = (0, 0, width, height)
    if min(height, width) <= 2 * EDGE or (box := content_box(rgb)) is None:
        return whole
    left, top = max(0, box[0] - pad), max(0, box[1] - pad)
    right, bottom = min(width, box[2] + pad + 1), min(height, box[3] + pad + 1)
    return whole if (right - left) * (bottom - top) < least * width * height else (left, top, right, bottom)


def frame_depth(lines: np.ndarray, band: int = 8, strong: int = 40, span: float = 0.7, halo: int = 6) -> int:
    """How many lines from the edge inwards belong to a coloured frame that plain background follows; else 0."""
    seen = False
    for depth, line in enumerate(lines[: band + halo + 1]):
        middle = np.median(line, axis=0)
        uniform = (np.abs(line - middle).max(axis=1) <= UNIFORM).mean() >= UNIFORM_SHARE
        coloured = int(middle.max() - middle.min()) >= SOFT_CHROMA
        if uniform and not coloured:
            if seen:
                return depth
        elif (chroma(line) >= strong).mean() >= span or uniform:
            seen = True
        else:
            return 0
    return 0


def strip_frame(rgb: np.ndarray, rounds: int = 3) -> tuple[tuple[int, int, int, int], bool]:
    """Half-open box inside a coloured frame, and whether a frame was taken off."""
    height, width = rgb.shape[:2]
    left, top, right, bottom = 0, 0, width, height
    bound, found = [0, 0, width, height], False
    for _ in range(rounds):
        if min(right - left, bottom - top) <= 2 * EDGE or (box := content_box(rgb[top:bottom, left:right])) is None:
            break
        left, top, right, bottom = left + box[0], top + box[1], left + box[2] + 1, top + box[3] + 1
        part = rgb[top:bottom, left:right]
        sides = [frame_depth(part), frame_depth(part[::-1]), frame_depth(part.transpose(1, 0, 2)), frame_depth(part[:, ::-1].transpose(1, 0, 2))]
        if sides[0] + sides[1] >= bottom - top:
            sides[:2] = 0, 0
        if sides[2] + sides[3] >= right - left:
            sides[2:] = 0, 0
        if not any(sides):
            break
        found = True
        top, bottom, left, right = top + sides[0], bottom - sides[1], left + sides[2], right - sides[3]
        bound = [left if sides[2] else bound[0], top if sides[0] else bound[1], right if sides[3] else bound[2], bottom if sides[1] else bound[3]]
    left, top = max(bound[0], left - 2), max(bound[1], top - 2)
    right, bottom = min(bound[2], right + 2), min(bound[3], bottom + 2)
    inner = trim_box(rgb[top:bottom, left:right], 2)
    return (left + inner[0], top + inner[1], left + inner[2], top + inner[3]), found


def expand_to_frame(rgb: np.ndarray, box: tuple[int, int, int, int], outward: int = 300, inward: int = 60, strong: int = 20, span: float = 0.55) -> tuple[int, int, int, int]:
    """The box of a frame that encloses ``box`` on all four sides, and two pixels; else ``box``."""
    x0, y0, x1, y1 = map(int, box)
    height, width = rgb.shape[:2]
    if x1 <= x0 or y1 <= y0:
        return box
    hit = chroma(rgb) >= strong

    def first(lines, scan) -> int | None:
        return next((i for i in lines if scan(i)), None)

    row = lambda y: x1 > x0 and hit[y, max(0, x0) : x1].mean() >= span if hit[y, max(0, x0) : x1].size else False
    top = first(range(max(0, y0 - outward), min(height, y0 + inward)), row)
    bottom = first(range(min(height - 1, y1 + outward), max(-1, y1 - inward), -1), row)
    if top is None or bottom is None or bottom <= top:
        return box
    column = lambda x: hit[top : bottom + 1, x].mean() >= span
    left = first(range(max(0, x0 - outward), min(width, x0 + inward)), column)
    right = first(range(min(width - 1, x1 + outward), max(-1, x1 - inward), -1), column)
    if left is None or right is None or right <= left:
        return box
    return max(0, left - 2), max(0, top - 2), min(width, right + 3), min(height, bottom + 3)


def erase_corner_arcs(rgb: np.ndarray, window: int = 18, strong: int = SOFT_CHROMA, share: float = 0.6) -> np.ndarray:
    """Coloured remains of round corners that touch the image's edge, painted over; large ones stay, as do images under 6 pixels."""
    out, (height, width) = rgb.copy(), rgb.shape[:2]
    k = min(window, height // 2, width // 2)
    if min(height, width) < 6:
        return out
    for down in (False, True):
        for across in (False, True):
            view = out[::-1] if down else out
            view = view[:, ::-1] if across else view
            part = view[:k, :k]
            hit = chroma(part) >= strong
            reached = np.zeros_like(hit)
            reached[0], reached[:, 0] = hit[0], hit[:, 0]
            while True:  # grow over the four neighbours until nothing is added
                grown = reached.copy()
                grown[1:] |= reached[:-1]
                grown[:-1] |= reached[1:]
                grown[:, 1:] |= reached[:, :-1]
                grown[:, :-1] |= reached[:, 1:]
                grown &= hit
                if (grown == reached).all():
                    break
                reached = grown
            if reached.any() and reached.sum() <= share * k * k:
                part[reached] = np.median(part[~hit], axis=0).astype(out.dtype) if (~hit).any() else 255
    return out


def extend_to_content(rgb: np.ndarray, box: tuple[int, int, int, int], most: int = 40, least: int = 3) -> tuple[int, int, int, int]:
    """A box moved outwards, side by side, while its edge still cuts through content."""
    x0, y0, x1, y1 = box
    height, width = rgb.shape[:2]
    content = (rgb.min(axis=2) < 200) | (chroma(rgb) >= SOFT_CHROMA)
    for _ in range(most):
        if not (y1 < height and content[y1 - 1, x0:x1].sum() >= least):
            break
        y1 += 1
    for _ in range(most):
        if not (x1 < width and content[y0:y1, x1 - 1].sum() >= least):
            break
        x1 += 1
    for _ in range(most):
        if not (y0 > 0 and content[y0, x0:x1].sum() >= least):
            break
        y0 -= 1
    for _ in range(most):
        if not (x0 > 0 and content[y0:y1, x0].sum() >= least):
            break
        x0 -= 1
    return x0, y0, x1, y1
