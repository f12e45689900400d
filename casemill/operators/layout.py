"""Page-image operators that need arrays only, and the interfaces of those that need an engine.

Images travel as encoded bytes in a BINARY column and become arrays inside a worker. The
engines (raster, detector, recogniser) are plug-ins; none is needed by anything else here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.schemas import PAGES

#: Rows of a page: least tolerance, and share of the mean block height.
ROW_TOLERANCE, ROW_SHARE = 12.0, 0.65
#: Lines: share of the greatest row sum, least height, padding.
LINE_SHARE, LINE_HEIGHT, LINE_PAD = 0.05, 10, 10


def line_bands(binary: np.ndarray) -> list[tuple[int, int]]:
    """(top, bottom) of text lines by row sums; the whole page if there is none."""
    sums = binary.astype(np.float64).sum(axis=1)
    height = len(sums)
    if not height or sums.max() == 0:
        return [(0, height)]
    text = np.concatenate(([False], sums > sums.max() * LINE_SHARE, [False]))
    edges = np.flatnonzero(text[1:] != text[:-1])
    bands = [(max(0, a - LINE_PAD), min(height, b + LINE_PAD)) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a > LINE_HEIGHT]
    return bands or [(0, height)]


def _normal(sums: np.ndarray) -> np.ndarray | None:
    return sums / sums.max() if len(sums) and sums.max() > 0 else None


def row_profile(binary: np.ndarray) -> dict[str, float]:
    """Shape of the row sums. A blank page has all densities at zero."""
    p = _normal((binary > 0).sum(axis=1).astype(np.float64))
    if p is None:
        return {"peak_sharpness": 0.0, "peak_position": 0.5, "valley_depth": 0.0, "profile_variance": 0.0, "top_density": 0.0, "bottom_density": 0.0, "mid_density": 0.0}
    third, mid = len(p) // 3, len(p) // 2
    mean = lambda part: float(part.mean()) if len(part) else 0.0
    top, bottom = mean(p[:third]), mean(p[2 * third :])
    return {
        "peak_sharpness": float(p.std()),
        "peak_position": float(p.argmax()) / max(1, len(p) - 1),
        "valley_depth": float(p.max()) - min(top, bottom),
        "profile_variance": float(p.var()),
        "top_density": top,
        "bottom_density": bottom,
        "mid_density": mean(p[mid - 10 : mid + 10]) if mid >= 10 and mid + 10 <= len(p) else 0.0,
    }


def column_profile(binary: np.ndarray) -> dict[str, float]:
    p = _normal((binary > 0).sum(axis=0).astype(np.float64))
    if p is None:
        return {"v_profile_variance": 0.0, "v_peak_sharpness": 0.0, "column_std": 0.0}
    dense = np.flatnonzero(p > 0.3)
    return {"v_profile_variance": float(p.var()), "v_peak_sharpness": float(p.std()), "column_std": float(dense.std()) if len(dense) else 0.0}


def headline_score(binary: np.ndarray, components: int, mean_height: float) -> float:
    """How much long thin runs of dense rows look like the headline of Devanagari; 0 to 1."""
    p = _normal((binary > 0).sum(axis=1).astype(np.float64))
    strong = np.flatnonzero(p > 0.45) if p is not None and components >= 5 else np.zeros(0, dtype=int)
    if len(strong) < 2:
        return 0.0
    runs = [r for r in np.split(strong, np.flatnonzero(np.diff(strong) > 2) + 1) if len(r) > 3]
    if not runs:
        return 0.0
    cover = max(map(len, runs)) / max(1, len(p))
    thin = max(0.0, *(1.0 - min(1.0, (r[-1] - r[0]) / (mean_height * 3 + 1)) for r in runs))
    return float(min(1.0, cover + thin))


def grid_density(binary: np.ndarray) -> float:
    """Share of the cells of a 20 x 20 grid that are more than a twentieth filled."""
    height, width = binary.shape
    ch, cw = max(1, height // 20), max(1, width // 20)
    cells = [binary[y : y + ch, x : x + cw] for y in range(0, height, ch) for x in range(0, width, cw)]
    return sum((c > 0).mean() > 0.05 for c in cells) / max(1, len(cells))


def recommended_profile(noise: Column, contrast: Column) -> Column:
    return F.when(noise < 50, "denoise-heavy").when(contrast < 35, "contrast-heavy").when((contrast > 70) & (noise > 1000), "otsu").otherwise("adaptive")


def script_decision(devanagari: Column, latin: Column, numeric: Column) -> Column:
    """(script, confidence) from scores of 0 to 1."""
    top = F.greatest(devanagari, latin)
    shape = lambda s, c: F.struct(F.lit(s).alias("script"), c.cast("double").alias("confidence"))
    first = (
        F.when((devanagari > latin * 1.3) & (devanagari > 0.25), shape("devanagari", devanagari))
        .when((latin > devanagari * 1.3) & (latin > 0.25), shape("latin", latin))
        .when((F.abs(devanagari - latin) < 0.15) & (top > 0.3), shape("mixed", top))
        .when((numeric > 0.50) & (top < 0.30), shape("numeric_heavy", numeric))
        .otherwise(shape("latin", F.greatest(F.lit(0.3), latin)))
    )
    digits = (numeric > 0.60) & (first["script"] != "numeric_heavy") & (first["confidence"] < 0.50)
    return F.when(digits, shape("mixed", F.greatest(first["confidence"], numeric))).otherwise(first)


def script_scores(f) -> tuple[Column, Column, Column]:
    """(devanagari, latin, numeric) scores of 0 to 1 from a page's measures, given by name."""
    one = F.lit(1.0)
    cut = lambda c: F.least(one, F.greatest(F.lit(0.0), c))
    top = lambda c: F.least(one, c)
    devanagari = (
        f["headline"] * 0.35 + top(f["valley_depth"] * 2.0) * 0.15 + top(f["mid_density"] * 1.5) * 0.10 + (1.0 - top(f["circularity"] * 2.0)) * 0.10
        + top(f["height_std"] / 20.0) * 0.10 - top(f["tall_ratio"]) * 0.05 + top(f["aspect_mean"] * 0.5) * 0.10 + f["grid_density"] * 0.05
    )
    latin = (
        top(f["tall_ratio"] * 2.0) * 0.20 + f["circularity"] * 0.20 + (1.0 - f["headline"]) * 0.20 + (1.0 - f["mid_density"]) * 0.10
        + top(f["complexity"] * 0.5) * 0.15 + top(f["width_std"] / 30.0) * 0.15
    )
    return cut(devanagari), cut(latin), cut(f["numeric_density"] * 2.0)


def normal_pages(results: DataFrame) -> DataFrame:
    """Engines' page results with every column that later steps read: text under either name, confidence under either, lists never null."""
    has = lambda name: F.col(name) if name in results.columns else F.lit(None)
    text = F.coalesce(F.when(has("raw_text") != "", has("raw_text")), has("text"), F.lit(""))
    confidence = F.coalesce(has("confidence").try_cast("double"), has("ocr_confidence").try_cast("double"), F.lit(0.0))
    lists = {c: F.coalesce(has(c).cast(PAGES[c].dataType), F.array().cast(PAGES[c].dataType)) for c in ("line_results", "uncertain_regions")}
    engine = F.coalesce(has("source_engine").cast("string"), F.lit("unknown"))
    usage = F.coalesce(has("engine_usage").cast(PAGES["engine_usage"].dataType), F.create_map(engine, F.lit(1)))
    return results.select(
        F.col("document").cast("string").alias("document"), F.col("page").cast("int").alias("page"), text.alias("raw_text"), confidence.alias("confidence"),
        F.coalesce(has("processing_time_ms").try_cast("double"), F.lit(0.0)).alias("processing_time_ms"), engine.alias("source_engine"), usage.alias("engine_usage"), *(v.alias(k) for k, v in lists.items()),
    )


def region_type(rel_y: Column, density: Column, aspect: Column, contours: Column, largest_area: Column, height_share: Column) -> Column:
    """(type, confidence) of a region from its measures."""
    shape = lambda s, c: F.struct(F.lit(s).alias("type"), F.lit(c).alias("confidence"))
    return (
        F.when((contours == 0) | contours.isNull(), shape("paragraph", 0.5))
        .when((rel_y > 0.7) & (density < 0.15) & (aspect > 2.0) & (contours < 15) & (largest_area > 100), shape("signature", 0.8))
        .when((density > 0.3) & (aspect > 0.8) & (aspect < 1.5), shape("stamp", 0.7))
        .when((rel_y < 0.15) & (height_share < 0.1), shape("header", 0.9))
        .otherwise(shape("paragraph", 0.9))
    )


def scaled_box(box: Column, scale: Column) -> Column:
    """Four corner points of a box given as [x1, y1, x2, y2] or as points, in the page's own scale."""
    cut = lambda v: (v / scale).cast("int")
    corners = F.array(F.array(cut(box[0]), cut(box[1])), F.array(cut(box[2]), cut(box[1])), F.array(cut(box[2]), cut(box[3])), F.array(cut(box[0]), cut(box[3])))
    points = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(cut(F.get(box, 2 * i)), cut(F.get(box, 2 * i + 1))))
    return F.when(F.size(box) == 4, corners).otherwise(points)


def parse_blocks(texts: Column, scores: Column, boxes: Column, scale: Column) -> Column:
    """(box, text, conf) of recognised blocks given as parallel arrays; blank texts and those without a box go."""
    zipped = F.arrays_zip(texts.alias("text"), scores.alias("score"), boxes.alias("box"))
    named = F.filter(zipped, lambda b: F.coalesce(F.trim(b["text"]) != "", F.lit(False)) & b["box"].isNotNull())
    return F.transform(named, lambda b: F.struct(scaled_box(b["box"], scale).alias("box"), F.trim(b["text"]).alias("text"), F.coalesce(b["score"], F.lit(0.0)).alias("conf")))


@dataclass(frozen=True)
class Engines:
    """raster: encoded bytes -> page images. recognise: image -> (text, confidence, lines as dicts). Both run in a worker."""

    raster: Callable[[bytes, str], Iterator[np.ndarray]]
    recognise: Callable[[np.ndarray], tuple[str, float, list[dict]]]
    name: str = "engine"


def recognise_pages(files: DataFrame, engines: Engines | None) -> DataFrame:
    """Files (path, content) to a row per page, in the schema of `PAGES`. Without engines it refuses, as nothing could be read."""
    if engines is None:
        raise RuntimeError("no recognition engine is configured")
    fields = [f.name for f in PAGES]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                for n, image in enumerate(engines.raster(content, path)):
                    text, confidence, lines = engines.recognise(image)
                    rows.append({"document": path, "page": n, "raw_text": text, "confidence": float(confidence), "processing_time_ms": 0.0, "source_engine": engines.name, "engine_usage": {engines.name: 1}, "line_results": lines, "uncertain_regions": []})
            yield pd.DataFrame(rows, columns=fields)

    return files.select("path", "content").mapInPandas(run, PAGES)
