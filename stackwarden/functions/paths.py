"""Expressions over paths: name, suffix, kind, category, folder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column, use) -> Column:
    """use(value), with the value worked out once: inside a lambda, or where a filter is pushed below it,
    an expression would be repeated at each mention."""
    return F.transform(F.array(value), use)[0]


def unify_separators(path) -> Column:
    return F.translate(_c(path), "\\", "/")


def file_name(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/\\]+)[/\\]*$", 1)


def suffix(path) -> Column:
    """Lower-cased extension without the dot; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))


def stem(name) -> Column:
    """A file name without its extension."""
    return F.regexp_replace(_c(name), r"^(.+)\.[^.]+$", "$1")


def dotted_suffix(name) -> Column:
    """The extension as written, with its dot, or an empty string."""
    return F.regexp_extract(_c(name), r"^.+(\.[^.]+)$", 1)


def parent_dir(path) -> Column:
    return F.regexp_replace(unify_separators(path), r"/[^/]*$", "")


def kind_of(path) -> Column:
    ext = suffix(path)
    return (
        F.when(ext.isin(K.IMAGE_EXTS), "image")
        .when(ext.isin(K.DOC_EXTS), ext)
        .when(ext.isin(K.VIDEO_EXTS), "video")
        .otherwise("other")
    )


def has_extension(path, extensions) -> Column:
    return suffix(path).isin(list(extensions))


def is_document(kind) -> Column:
    return _c(kind).isin(K.DOC_EXTS)


def is_screenshot(path) -> Column:
    return F.lower(_c(path)).rlike("screen[-_]?shot")


def hamming_radius(path) -> Column:
    """The radius within which a later image joins an earlier one."""
    return F.when(is_screenshot(path), F.lit(K.RADIUS_SCREENSHOT)).otherwise(F.lit(K.RADIUS_PHOTO))


def is_screen_size(width, height) -> Column:
    """Exactly the size of a known phone or desktop screen, in either orientation."""
    w, h = _c(width), _c(height)
    pair = F.concat_ws("x", F.least(w, h), F.greatest(w, h))
    known = [f"{min(s)}x{max(s)}" for s in K.PHONE_SCREENS + K.DESKTOP_SCREENS]
    return F.coalesce(w.isNotNull() & h.isNotNull() & pair.isin(known), F.lit(False))


def is_relevant(path, size, width, height) -> Column:
    """Likely user content: large enough, outside technical folders, images of a visible size."""
    p = F.lower(unify_separators(path))
    technical = F.lit(False)
    for part in K.TECHNICAL_PATH_PARTS:
        technical = technical | p.contains(part)
    visible = F.coalesce(
        (_c(width) >= K.RELEVANT_MIN_PIXELS) & (_c(height) >= K.RELEVANT_MIN_PIXELS), F.lit(False)
    )
    image = has_extension(path, K.GROUPING_IMAGE_EXTS)
    return (_c(size) >= K.RELEVANT_MIN_BYTES) & ~technical & (~image | visible)


def category_of_folder(folder) -> Column:
    """First segment of a folder path, 'Custom' when there is none."""
    first = F.split(unify_separators(folder), "/")[0]
    return F.coalesce(F.nullif(first, F.lit("")), F.lit("Custom"))


def join_folder(root, folder) -> Column:
    """Destination directory: the folder's segments below the root."""
    tail = F.regexp_replace(unify_separators(folder), "/+", "/")
    return F.concat_ws("/", F.regexp_replace(_c(root), "/+$", ""), F.regexp_replace(tail, "^/|/$", ""))


def training_label(path, root: str) -> Column:
    """Parent directory relative to the root, empty for files at the root or outside of it."""
    base = root.replace("\\", "/").rstrip("/") + "/"
    parent = F.concat(parent_dir(path), F.lit("/"))
    inside = F.substring(parent, F.lit(len(base) + 1), F.length(parent))
    return F.when(parent.startswith(base), F.regexp_replace(inside, "/$", "")).otherwise("")
