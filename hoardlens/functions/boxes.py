"""Expressions over bounding boxes, masks and crops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hoardlens.functions import paths

MIN_SIDE = 112  # smallest side an embedding model is given
CROP_PADDING = 0.1  # share of the box added on every side of a crop


def box_metrics(
    x1: Column, y1: Column, x2: Column, y2: Column, image_width: Column, image_height: Column
) -> dict[str, Column]:
    """Width, height, area, share of the image and centre of a box."""
    width, height = x2 - x1, y2 - y1
    pixels = image_width.cast("double") * image_height.cast("double")
    return {
        "bbox_width": width,
        "bbox_height": height,
        "bbox_area": width * height,
        "bbox_area_ratio": F.try_divide(width * height, pixels),
        "bbox_center_x": (x1 + x2) / 2,
        "bbox_center_y": (y1 + y2) / 2,
    }


def mask_area(mask: Column) -> Column:
    """Sum of a mask given as an array of per-pixel values."""
    return F.aggregate(mask, F.lit(0.0), lambda total, pixel: total + pixel.cast("double"))


def mask_metrics(area: Column, image_width: Column, image_height: Column) -> dict[str, Column]:
    """Mask columns of a detection; NULL areas mean there was no mask."""
    pixels = image_width.cast("double") * image_height.cast("double")
    return {
        "has_segmentation": area.isNotNull(),
        "mask_area": area.cast("double"),
        "mask_area_ratio": F.try_divide(area.cast("double"), pixels),
    }


def whole_pixels(coordinate: Column) -> Column:
    """Coordinate cut off towards zero."""
    return coordinate.cast("int")


def padded_crop(
    x1: Column, y1: Column, x2: Column, y2: Column, image_width: Column, image_height: Column
) -> dict[str, Column]:
    """Integer box grown by the padding and clamped to the image."""
    pad_x = ((x2 - x1) * CROP_PADDING).cast("int")
    pad_y = ((y2 - y1) * CROP_PADDING).cast("int")
    return {
        "crop_x1": F.greatest(F.lit(0), x1 - pad_x),
        "crop_y1": F.greatest(F.lit(0), y1 - pad_y),
        "crop_x2": F.least(image_width, x2 + pad_x),
        "crop_y2": F.least(image_height, y2 + pad_y),
    }


def crop_name(folder: str, path: Column, index: Column) -> Column:
    """Path of a face crop below ``folder``; a hash keeps apart images of one name in two folders."""
    mark = F.left(F.sha2(path, 256), F.lit(12))
    return F.format_string(
        "%s/%s_%s_face_%02d%s", F.lit(folder.rstrip("/")), paths.stem(path), mark, index, paths.suffix(path)
    )


def model_input_size(width: Column, height: Column) -> dict[str, Column]:
    """Size a small crop is enlarged to so that both sides reach the minimum."""
    side = F.lit(float(MIN_SIDE))
    scale = F.greatest(F.try_divide(side, height), F.try_divide(side, width))
    small = (height < MIN_SIDE) | (width < MIN_SIDE)
    return {
        "input_width": F.when(small, (width * scale).cast("int")).otherwise(width),
        "input_height": F.when(small, (height * scale).cast("int")).otherwise(height),
    }
