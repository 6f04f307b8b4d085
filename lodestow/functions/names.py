"""Column functions on file names, paths, ids and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ci_key(c: Column) -> Column:
    """A key that ignores case, by simple upper-casing."""
    return F.upper(c)


def blank_as_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def extension(path: Column) -> Column:
    """The part of a file's name after its last dot, in lower case and without the dot; '' if it has none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def content_id(file_name: Column) -> Column:
    """The 32 hex digits that a content file's name starts with, in lower case; '' for shorter names."""
    bare = F.regexp_replace(stem(file_name), r"(?i)\.cnmt$", "")
    return F.when(F.length(bare) >= 32, F.lower(F.substring(bare, 1, 32))).otherwise(F.lit(""))


def is_hex_id(c: Column, digits: int = 16) -> Column:
    return c.rlike(f"^[0-9a-fA-F]{{{digits}}}$")


def base_id(title_id: Column) -> Column:
    """A title id of up to 16 hex digits with its last 16 bits cleared, in upper case; '' if it is no hex number."""
    full = F.lpad(F.upper(title_id), 16, "0")
    return F.when(title_id.rlike("^[0-9a-fA-F]{1,16}$"), F.concat(F.substring(full, 1, 12), F.lit("0000"))).otherwise(F.lit(""))


def version_text(c: Column) -> Column:
    """A display version: blank is 1.0.0, a leading v goes."""
    return F.coalesce(F.regexp_replace(blank_as_null(c), "^[vV]", ""), F.lit("1.0.0"))


def without_forbidden(c: Column, instead: str = "") -> Column:
    """A name without the characters that files cannot have in theirs."""
    return F.regexp_replace(c, r'[\\/:*?"<>|]', instead)


def composed_name(name: Column, ident: Column, tags: Column, version: Column, number: Column) -> Column:
    """``name [id] (tags) [v1.0] [v65536]``: parts that are null or blank are left out, white space is single."""
    parts = [blank_as_null(name), F.concat(F.lit("["), blank_as_null(ident), F.lit("]")), F.concat(F.lit("("), blank_as_null(tags), F.lit(")")), F.concat(F.lit("[v"), blank_as_null(version), F.lit("]")), F.concat(F.lit("[v"), number.cast("string"), F.lit("]"))]
    return F.trim(F.regexp_replace(without_forbidden(F.concat_ws(" ", *parts)), r"\s+", " "))


def without_disc(title: Column) -> Column:
    """A title without the bracketed number of its disc: ``disc`` or ``disk`` and a number or letter, in any brackets, with or without how many there are."""
    return F.trim(F.regexp_replace(title, r"(?i)\s*[(\[{]\s*dis[ck]\s+[0-9a-z]+(?:\s+of\s+[0-9]+)?\s*[)\]}]", ""))


#: The endings of volumes: what is kept of the name, and the number.
_VOLUMES = {".rar": r"(?i)^(.+)\.part([0-9]+)\.rar$", ".7z": r"(?i)^(.+)\.7z\.([0-9]{3,})$", ".zip": r"(?i)^(.+)\.zip\.([0-9]{3,})$"}
#: Endings of archives that are one file.
ARCHIVES = (".zip", ".7z", ".rar")


def is_volume(name: Column) -> Column:
    """Whether a file is one volume of an archive: NAME.partN.rar, NAME.7z.NNN or NAME.zip.NNN."""
    return F.coalesce(*[F.when(name.rlike(p), F.lit(True)) for p in _VOLUMES.values()], F.lit(False))


def volume_key(name: Column) -> Column:
    """What the volumes of one archive share, in lower case: the archive's name; of any other file its own."""
    return F.lower(F.coalesce(*[F.when(name.rlike(p), F.concat(F.regexp_extract(name, p, 1), F.lit(end))) for end, p in _VOLUMES.items()], name))


def volume_part(name: Column) -> Column:
    """A volume's number; null for a file that is not a volume."""
    return F.coalesce(*[F.when(name.rlike(p), F.regexp_extract(name, p, 2)) for p in _VOLUMES.values()]).cast("int")


def is_first_volume(name: Column) -> Column:
    """Whether an archive can be opened by this file: volume 1, or a file that is not a volume."""
    return F.coalesce(volume_part(name) == 1, F.lit(True))


def is_archive(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(*[F.when(F.endswith(low, F.lit(end)), F.lit(True)) for end in ARCHIVES], is_volume(name))


def archive_title(name: Column) -> Column:
    """The name to show for an archive or one of its volumes: without the ending and the number."""
    return F.coalesce(*[F.when(name.rlike(p), F.regexp_extract(name, p, 1)) for p in _VOLUMES.values()], stem(name))


def has_hangul(c: Column) -> Column:
    """Whether a name has a precomposed Hangul syllable (U+AC00 to U+D7A3)."""
    return c.rlike("[\uac00-\ud7a3]")


def hex_text(data: Column, lower: bool = True) -> Column:
    return F.lower(F.hex(data)) if lower else F.hex(data)


def hex_bytes(text: Column) -> Column:
    """The bytes of an even number of hex digits; null for any other text."""
    return F.when(text.rlike("^(?:[0-9a-fA-F]{2})*$"), F.unhex(text))


def folder_role(path: Column) -> Column:
    """What a folder holds, by its own name: update or dlc if that stands behind an underscore in it, else base."""
    own = F.lower(base_name(path))
    return F.when(F.contains(own, F.lit("_update")), "update").when(F.contains(own, F.lit("_dlc")), "dlc").otherwise("base")


def is_title_path(path: Column) -> Column:
    """Whether a path ends in a folder of eight hex digits within another one: a title's place by its id."""
    return path.rlike(r"(?:^|[/\\])[0-9a-fA-F]{8}[/\\][0-9a-fA-F]{8}$")


#: The extensions of binary patches.
PATCHES = ("xdelta", "xdelta3", "ips", "ups", "bps", "ppf", "aps")


def patch_kind(path: Column) -> Column:
    """patch for a file that changes another one, overwrite for one that takes its place."""
    return F.when(extension(path).isin(*PATCHES), "patch").otherwise("overwrite")


def patch_target(path: Column) -> Column:
    """The name of the file that a patch is for: its own without the last extension; any other file's own name."""
    return F.when(extension(path).isin(*PATCHES), stem(path)).otherwise(base_name(path))


def track_type(text: Column) -> Column:
    """A cue sheet's track type of a metadata type, by what it contains; MODE2/2352 if it says nothing known."""
    up = F.upper(F.regexp_replace(text, "_", "/"))
    known = [("AUDIO", "AUDIO"), ("MODE1/2352", "MODE1/2352"), ("MODE2/2336", "MODE2/2336")]
    return F.coalesce(*[F.when(F.contains(up, F.lit(k)), v) for k, v in known], F.lit("MODE2/2352"))


def reader_of(path: Column) -> Column:
    """Which reader takes a disc image's descriptor, by its extension; null for none."""
    kinds = {"cue": "cue", "gdi": "gdi", "ccd": "ccd", "img": "ccd", "mds": "mds", "mdf": "mds", "iso": "iso", "chd": "chd"}
    return F.coalesce(*[F.when(extension(path) == k, F.lit(v)) for k, v in kinds.items()])


def disc_id(text: Column) -> Column:
    """XXXX_ddd.dd as XXXXddddd."""
    return F.upper(F.regexp_replace(F.regexp_extract(text, r"([A-Za-z]{4}_\d{3}\.\d{2})", 1), r"[_.]", ""))


def glob_match(path: Column, pattern: str) -> Column:
    """Whether all of ``path`` matches a pattern with * and ?."""
    special = set("\\^$.|+()[]{}")
    return path.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in pattern) + "$")


def numbered(name: Column, nth: Column) -> Column:
    """Output names that do not clash: the first as it is, later ones with `` (n)`` before the extension."""
    return F.when(nth == 1, name).otherwise(F.concat(F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.lit(" ("), (nth - 1).cast("string"), F.lit(")"), F.regexp_extract(name, r"(\.[^.]*)?$", 1)))


def map_get(m: Column, key: Column, otherwise: Column) -> Column:
    """A map's value for a key, or what stands in for it."""
    return F.coalesce(F.try_element_at(m, key), otherwise)


def map_add(m: Column, key: Column, value: Column) -> Column:
    """The map with one more entry, or as it is where it has the key."""
    return F.when(F.map_contains_key(m, key), m).otherwise(F.map_concat(m, F.create_map(key, value)))


def map_inverted(m: Column) -> Column:
    """Keys by values; of several keys of one value the least."""
    pairs = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
    first = F.filter(pairs, lambda e, i: (i == 0) | (F.get(pairs, i - 1)["v"] != e["v"]))
    return F.map_from_entries(first)
