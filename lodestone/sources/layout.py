"""Pages as words with boxes, tables over pages, and scanned images as pixel arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_lines(words: DataFrame) -> DataFrame:
    """(doc, page, top, text, band) of words (doc, page, text, x0, top, page_h): words of one rounded height, left to right."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    rows = words.groupBy("doc", "page", "page_h", F.bround("top").alias("top")).agg(joined.alias("text"))
    band = F.when(F.col("top") < 0.1 * F.col("page_h"), "header").when(F.col("top") > 0.9 * F.col("page_h"), "footer").otherwise("body")
    return rows.select("doc", "page", "top", "text", band.alias("band"))


def without_furniture(lines: DataFrame, furniture: DataFrame) -> DataFrame:
    """Lines whose signature is not in furniture (sig)."""
    from ..functions.text import line_signature

    return lines.join(furniture.select(F.col("sig").alias("_sig")), line_signature(F.col("text")) == F.col("_sig"), "left_anti")


def gutters(words: pd.DataFrame, width: float, bin_pt: float = 3.0, least_pt: float = 30.0, margin: float = 0.12) -> list[float]:
    """Centres of empty vertical stretches of a page, margins left out."""
    n = int(width / bin_pt) + 1
    full = np.zeros(n + 1, bool)
    for a, b in zip(words["x0"], words["x1"], strict=True):
        full[max(0, int(a / bin_pt)) : min(n - 1, int(b / bin_pt)) + 1] = True
    low, high = int(n * margin), int(n * (1 - margin))
    empty = np.r_[False, ~full[low : min(high + 1, n)], False]
    edges = np.flatnonzero(np.diff(empty.astype(int)))
    out = []
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        closed = low + b <= high  # a stretch that runs into the margin stays open
        if closed and (b - a) * bin_pt >= least_pt:
            out.append((2 * low + a + b) / 2 * bin_pt)
    return out


def reading_order(words: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """(doc, page, columns, text) of words (doc, page, text, x0, x1, top, page_w): column after column, line after line."""

    def page(group: pd.DataFrame) -> pd.DataFrame:
        edges = [0.0, *gutters(group, float(group["page_w"].iloc[0])), float(group["page_w"].iloc[0])]
        lines: list[str] = []
        middle = (group["x0"] + group["x1"]) / 2
        for a, b in zip(edges, edges[1:], strict=False):
            own = group[(middle >= a) & (middle < b)]
            own = own.assign(t=own["top"].round(1)).sort_values(["t", "x0"], kind="stable")
            anchor, now = None, []
            for top, text in zip(own["top"], own["text"], strict=True):
                if anchor is not None and abs(top - anchor) > tolerance:
                    lines.append(" ".join(now))
                    anchor, now = None, []
                anchor = top if anchor is None else anchor
                now.append(text)
            if now:
                lines.append(" ".join(now))
        first = group.iloc[0]
        return pd.DataFrame([{"doc": first["doc"], "page": first["page"], "columns": len(edges) - 1, "text": "\n".join(lines)}])

    return words.groupBy("doc", "page").applyInPandas(page, "doc string, page int, columns int, text string")


def stitch_tables(tables: DataFrame) -> DataFrame:
    """(doc, table, record) of tables (doc, seq, rows array<array<string>>): neighbours with one header are one table."""
    header = F.element_at("rows", 1)
    w = Window.partitionBy("doc").orderBy("seq")
    fresh = (~F.coalesce(F.lag(header).over(w) == header, F.lit(False))).cast("int")
    numbered = tables.withColumn("table", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))
    cells = numbered.select("doc", "table", "seq", header.alias("h"), F.posexplode(body).alias("i", "r"))
    width = F.least(F.size("h"), F.size("r"))
    return cells.select("doc", "table", "seq", "i", F.map_from_arrays(F.slice("h", 1, width), F.slice("r", 1, width)).alias("record"))


def autocontrast(image: np.ndarray, cutoff: float = 2.0) -> np.ndarray:
    """Stretches grey levels after cutting a percentage of pixels at both ends."""
    low, high = np.percentile(image, [cutoff, 100 - cutoff], method="nearest")
    if high <= low:
        return image
    return np.clip((image.astype(float) - low) * 255 / (high - low), 0, 255).astype(np.uint8)


def rotate(image: np.ndarray, degrees: float, fill: float) -> np.ndarray:
    """Counter-clockwise rotation about the middle, bilinear."""
    h, w = image.shape
    t = np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w].astype(float)
    dy, dx = y - (h - 1) / 2, x - (w - 1) / 2
    sx = np.cos(t) * dx - np.sin(t) * dy + (w - 1) / 2
    sy = np.sin(t) * dx + np.cos(t) * dy + (h - 1) / 2
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    padded = np.pad(image.astype(float), 1, constant_values=fill)
    inside = (x0 >= -1) & (x0 < w) & (y0 >= -1) & (y0 < h)
    x0, y0 = np.clip(x0, -1, w - 1) + 1, np.clip(y0, -1, h - 1) + 1
    top = padded[y0, x0] * (1 - fx) + padded[y0, x0 + 1] * fx
    low = padded[y0 + 1, x0] * (1 - fx) + padded[y0 + 1, x0 + 1] * fx
    return np.where(inside, top * (1 - fy) + low * fy, fill)


def skew(image: np.ndarray, most: int = 20) -> float:
    """The rotation, in whole degrees, after which rows of ink vary most; the first of equal ones."""
    ink = 255.0 - image
    scores = [np.var(rotate(ink, a, 0).astype(np.uint8).sum(axis=1, dtype=float)) for a in range(-most, most + 1)]
    return float(int(np.argmax(scores)) - most)


def otsu(image: np.ndarray) -> int:
    """The grey level that parts an image with the greatest variance between its parts; the first of equal ones."""
    count = np.bincount(image.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(count), np.cumsum(count * np.arange(256))
    above = below[-1] - below
    with np.errstate(invalid="ignore", divide="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    between[(below == 0) | (above == 0)] = -1
    return int(np.argmax(between)) if (between >= 0).any() else 0


def regions(binary: np.ndarray, band: int = 40) -> list[tuple[str, int, float, float]]:
    """(kind, top, density, changes per row) of bands with ink: text changes often and is light, all else is a figure."""
    ink = binary < 255
    out = []
    for top in range(0, len(ink), band):
        part = ink[top : top + band]
        if part.any():
            density = float(part.mean())
            changes = float((part[:, 1:] != part[:, :-1]).sum(axis=1).mean())
            out.append(("text" if changes >= 6 and density < 0.35 else "figure", top, density, changes))
    return out


def prepare_images(images: DataFrame) -> DataFrame:
    """(id, skew, threshold, text_regions, figure_regions) of images (id, height, width, pixels binary, grey levels)."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, h, w, raw in zip(batch["id"], batch["height"], batch["width"], batch["pixels"], strict=True):
                image = autocontrast(np.frombuffer(bytes(raw), np.uint8).reshape(h, w))
                angle = skew(image)
                image = rotate(image, angle, 255).astype(np.uint8)
                t = otsu(image)
                kinds = [r[0] for r in regions(np.where(image > t, 255, 0))]
                rows.append((i, angle, t, kinds.count("text"), kinds.count("figure")))
            yield pd.DataFrame(rows, columns=["id", "skew", "threshold", "text_regions", "figure_regions"])

    return images.mapInPandas(run, "id string, skew double, threshold int, text_regions int, figure_regions int")


def ocr_language(scripts) -> object:
    """eng for Latin, hin for Devanagari, both joined by +; eng for neither. A Column of array<string>."""
    both = F.array_compact(F.array(F.when(F.array_contains(scripts, "Latin"), "eng"), F.when(F.array_contains(scripts, "Devanagari"), "hin")))
    return F.when(F.size(both) > 0, F.array_join(both, "+")).otherwise("eng")
