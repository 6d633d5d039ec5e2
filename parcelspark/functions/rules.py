"""Rules on classified images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a building's picture, in the order in which they are looked for.
BUILDING = ("tower", "elevation", "building view", "cross section", "site plan", "master plan", "aerial", "bird's eye", "3d render", "silhouette", "skyline", "facade")


def building_keyword(alt: Column) -> Column:
    """The first of BUILDING that an alt text holds."""
    return F.get(F.filter(F.array(*map(F.lit, BUILDING)), lambda k: F.contains(F.lower(alt), k)), F.lit(0))


def relabelled(category: str = "category", alt: str = "alt_text") -> Column:
    """Floor plans whose alt text tells of a building are exteriors."""
    c = F.col(category)
    return F.when((c == "floor_plan") & building_keyword(F.col(alt)).isNotNull(), "exterior").otherwise(c)


def logo_category(category: str = "category") -> Column:
    """Logos with the shape or size of a page are no logos."""
    w, h, c = F.col("width"), F.col("height"), F.col(category)
    page = (w / h < 0.9) | ((h > 2000) & (w > 1500)) | (w > 2000) | (h > 2000)
    return F.when((c == "logo") & page, "other").otherwise(c)
