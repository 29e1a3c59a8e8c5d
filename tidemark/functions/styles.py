"""Checks of subtitle styles given as JSON objects, and the width that a style leaves for a line, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as T

# The fields of a style in the order in which they are checked, with the least and largest number allowed.
LINE_FIELDS = ("name", "font_name")
COLOUR_FIELDS = ("primary_color", "secondary_color", "outline_color", "back_color")
WHOLE_FIELDS = {
    "font_size": (1, 200),
    "scale_x": (1, 400),
    "scale_y": (1, 400),
    "alignment": (1, 9),
    "border_style": (1, 3),
    "encoding": (0, 255),
    "margin_l": (0, 2000),
    "margin_r": (0, 2000),
    "margin_v": (0, 2000),
}
REAL_FIELDS = {"outline": (0, 20), "shadow": (0, 20), "spacing": (-100, 100), "angle": (-360, 360)}
LATE_FIELDS = {"fade_in_ms": (0, 10000), "fade_out_ms": (0, 10000)}
FLAGS = ("bold", "italic", "underline", "strike_out")
RAW_PARTS = 23
#: Size of the picture that ASS positions refer to, and the share of it that a line may fill.
PLAY_WIDTH, PLAY_HEIGHT = 384, 288
SAFE_SHARE = 0.92

TEXTS = ("raw_ass_style", *LINE_FIELDS, *COLOUR_FIELDS, "override_tags")
KINDS = {t: "string" for t in TEXTS} | {f: "boolean" for f in FLAGS} | {f: "int" for f in (*WHOLE_FIELDS, *LATE_FIELDS)} | {f: "double" for f in REAL_FIELDS}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in KINDS.items())


def style(json: Column) -> Column:
    """The style as a struct; null where the text is no JSON object. Fields of another type are null."""
    return F.from_json(json, SCHEMA)


def bad_colour(value: Column) -> Column:
    """Whether a colour is neither #RRGGBB, #RRGGBBAA nor &HAABBGGRR; an empty one is left to the default."""
    return (value != "") & ~T.trim(value).rlike("^(?:#(?:[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})|&[Hh][0-9A-Fa-f]{8})$")


def bad_tags(value: Column) -> Column:
    """Whether override tags, in or without a pair of braces, do not begin with a backslash or hold braces or line ends."""
    bare = T.trim(value)
    bare = F.when(bare.startswith("{") & bare.endswith("}"), T.trim(F.regexp_replace(bare, r"^\{|\}$", ""))).otherwise(bare)
    return (bare != "") & (bare.rlike(r"[{}\n\r]") | ~bare.startswith("\\"))


def _field_checks(s: Column, expected: str) -> list[tuple[str, Column]]:
    """Each field in turn and whether it may not stay as it is."""
    raw = F.split(s["raw_ass_style"], ",")
    checks = [("raw_ass_style", (s["raw_ass_style"] != "") & ((F.size(raw) != RAW_PARTS) | (raw[0] != f"Style: {expected}")))]
    checks += [(f, s[f].rlike("[,\n\r]")) for f in LINE_FIELDS]
    checks += [(f, bad_colour(s[f])) for f in COLOUR_FIELDS]
    checks += [(f, ~s[f].between(*limits)) for f, limits in (WHOLE_FIELDS | REAL_FIELDS | LATE_FIELDS).items()]
    return [*checks, ("override_tags", bad_tags(s["override_tags"]))]


def _misread(json: Column, path: str, s: Column) -> list[Column]:
    """Whether the object at a path has unknown fields, or fields of another type than a style's."""
    keys = F.json_object_keys(F.get_json_object(json, path))
    mistyped = [F.get_json_object(json, f"{path}.{name}").isNotNull() & s[name].isNull() for name in KINDS if KINDS[name] != "string"]
    return [F.exists(keys, lambda k: ~k.isin(*KINDS)), *mistyped]


def style_fault(json: Column, expected: str) -> Column:
    """The first field of a style that may not stay as it is; null for a good style.

    `json` stands for an object that is no JSON, an unknown field or a value of another type; null texts are such, too.
    """
    s, keys = style(json), F.json_object_keys(json)
    checks = [("json", F.coalesce(keys.isNull() | s.isNull(), F.lit(True))), *(("json", m) for m in _misread(json, "$", s)), *_field_checks(s, expected)]
    return F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in checks))


# The screens and roles of a set of styles with the name of each role's raw line, and the fields of the
# styles that stand where no file sets one.
SCREENS, ROLES = ("horizontal", "vertical"), {"major": "Major", "minor": "Minor"}
SHARED_DEFAULTS = {
    "font_name": "Arial",
    "primary_color": "#FFBF00",
    "secondary_color": "&H000000FF",
    "outline_color": "&H00000000",
    "back_color": "&H64000000",
    "bold": True,
    "italic": False,
    "underline": False,
    "strike_out": False,
    "scale_x": 100,
    "scale_y": 100,
    "spacing": 0.0,
    "angle": 0.0,
    "border_style": 1,
    "alignment": 2,
    "margin_l": 10,
    "margin_r": 10,
    "encoding": 1,
}
OWN_FIELDS = ("font_size", "outline", "shadow", "margin_v")
OWN_DEFAULTS = {
    ("horizontal", "major"): (14, 2.5, 1.5, 20),
    ("horizontal", "minor"): (10, 2.5, 1.5, 30),
    ("vertical", "major"): (12, 2.2, 1.2, 92),
    ("vertical", "minor"): (7, 2.0, 1.0, 101),
}

_SCREEN = ", ".join(f"{role}: struct<{', '.join(f'{n}: {k}' for n, k in KINDS.items())}>" for role in ROLES)
SET_SCHEMA = f"struct<version: int, {', '.join(f'{screen}: struct<{_SCREEN}>' for screen in SCREENS)}>"


def default_value(screen: str, role: str, name: str) -> Column:
    """What a field of a style is before any file is read."""
    values = {"name": ROLES[role]} | SHARED_DEFAULTS | dict(zip(OWN_FIELDS, OWN_DEFAULTS[screen, role], strict=True))
    return F.lit(values.get(name)).cast(KINDS[name])


def default_set() -> Column:
    """The set of styles that stands before any file is read."""
    one = lambda screen, role: F.struct(*(default_value(screen, role, name).alias(name) for name in KINDS))
    screens = (F.struct(*(one(screen, role).alias(role) for role in ROLES)).alias(screen) for screen in SCREENS)
    return F.struct(F.lit(1).alias("version"), *screens)


def style_set(json: Column) -> Column:
    """A file's set of styles as a struct; what it does not set, or sets by another type, is null."""
    return F.from_json(json, SET_SCHEMA)


def set_fault(json: Column) -> Column:
    """Path of the first field of a set of styles that may not stay as it is, as in vertical.minor.outline; else null.

    `json` stands for a text that is not one JSON object alone, an unknown field at any level or a value of another
    type, which are looked for before any limit. A JSON null counts as not set.
    """
    # text after the object would break one of these, as it had to begin with the end of either
    only = (F.json_array_length(F.concat(F.lit("["), json, F.lit("]"))) == 1) & F.json_object_keys(F.concat(F.lit('{"a":'), json, F.lit("}"))).isNotNull()
    sides = lambda t: F.struct(*(F.from_json(t[screen], _ROLE_TEXTS).alias(screen) for screen in SCREENS))
    fields = lambda t: F.struct(*(F.struct(*(F.from_json(t[screen][role], _FIELD_TEXTS).alias(role) for role in ROLES)).alias(screen) for screen in SCREENS))
    lost = lambda given, value: given.isNotNull() & value.isNull()
    foreign = lambda t, names: F.exists(F.json_object_keys(t), lambda k: ~k.isin(*names))

    def fault(p: Column) -> Column:
        s, top, side, field = p["s"], p["top"], p["side"], p["field"]
        misread = [F.coalesce(~F.coalesce(p["only"], F.lit(False)) | F.json_object_keys(p["json"]).isNull() | s.isNull(), F.lit(True)), foreign(p["json"], ("version", *SCREENS)), lost(top["version"], s["version"])]
        checks = []
        for screen in SCREENS:
            misread += [lost(top[screen], s[screen]), foreign(top[screen], ROLES)]
            for role, expected in ROLES.items():
                one, given = s[screen][role], field[screen][role]
                misread += [lost(side[screen][role], one), foreign(side[screen][role], KINDS), *(lost(given[name], one[name]) for name in KINDS if KINDS[name] != "string")]
                checks += [(f"{screen}.{role}.{name}", bad) for name, bad in _field_checks(one, expected)]
        return F.coalesce(*(F.when(bad, F.lit("json")) for bad in misread), *(F.when(bad, F.lit(path)) for path, bad in checks))

    # each step is bound to a name, so that a text is parsed once for a level and not for every field
    parsed = F.struct(json.alias("json"), only.alias("only"), style_set(json).alias("s"), F.from_json(json, _SCREEN_TEXTS).alias("top"))
    parsed = _bound(parsed, lambda p: F.struct(*(p[c].alias(c) for c in ("json", "only", "s", "top")), sides(p["top"]).alias("side")))
    parsed = _bound(parsed, lambda p: F.struct(*(p[c].alias(c) for c in ("json", "only", "s", "top", "side")), fields(p["side"]).alias("field")))
    return _bound(parsed, fault)


#: Each level of a set with its values as texts, to tell what is given from what could be read.
_SCREEN_TEXTS = f"version string, {', '.join(f'{screen} string' for screen in SCREENS)}"
_ROLE_TEXTS = ", ".join(f"{role} string" for role in ROLES)
_FIELD_TEXTS = ", ".join(f"{name} string" for name in KINDS)


def _bound(value: Column, rule: Callable[[Column], Column]) -> Column:
    """rule(value), with the value worked out once however often the rule names it."""
    return F.get(F.transform(F.array(value), rule), F.lit(0))


def line_width(render_width: Column, render_height: Column, margin_l: Column, margin_r: Column, font_size: Column) -> Column:
    """Width that a line may have: the safe share of what margins leave of the scaled picture, but one character at least.

    A picture without a known size takes the whole play width; margins and size default to 10, 10 and 14.
    """
    known = (render_width > 0) & (render_height > 0)
    scale = F.least(F.lit(float(PLAY_WIDTH)) / render_width, F.lit(float(PLAY_HEIGHT)) / render_height)
    scaled = F.floor(render_width * scale)
    width = F.when(known & (scaled >= 1), scaled).otherwise(PLAY_WIDTH)
    size = F.coalesce(font_size, F.lit(14)).cast("double")
    return F.greatest((width - F.coalesce(margin_l, F.lit(10)) - F.coalesce(margin_r, F.lit(10))) * F.lit(SAFE_SHARE), size)
