"""Names, recognisers and JSON: string functions as columns, and two pandas UDFs where Unicode tables are needed."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scalars import col

# Phrases that mark an obituary.
OBITUARY_PHRASES = (" by ", " ate ", " almost dodged ", " couldn't hide from ", " saw the pretty lights", " caught ", " didn't see ", " feels ", " tried to invade ")

# The weapon that a phrase of an obituary stands for; the first that is found counts.
OBITUARY_WEAPONS = (
    ("'s super shotgun", "super_shotgun"),
    ("'s chaingun", "chaingun"),
    ("'s hyperblaster", "hyperblaster"),
    ("'s handgrenade", "grenades"),
    ("'s pain", "grenades"),
    ("'s grenade", "grenade_launcher"),
    ("'s shrapnel", "grenade_launcher"),
    ("'s rocket", "rocket_launcher"),
    ("'s BFG", "bfg10k"),
    (" was blasted by ", "blaster"),
    (" was gunned down by ", "shotgun"),
    (" was machinegunned by ", "machinegun"),
    (" was railed by ", "railgun"),
)

# HUD pickup names and the items they stand for.
PICKUP_ITEMS = {
    "railgun": "weapon_railgun", "chaingun": "weapon_chaingun", "rocket launcher": "weapon_rocketlauncher", "super shotgun": "weapon_supershotgun",
    "hyperblaster": "weapon_hyperblaster", "grenade launcher": "weapon_grenadelauncher", "shotgun": "weapon_shotgun", "machinegun": "weapon_machinegun",
    "bfg10k": "weapon_bfg", "body armor": "item_armor_body", "combat armor": "item_armor_combat", "jacket armor": "item_armor_jacket",
    "armor shard": "item_armor_shard", "adrenaline": "item_adrenaline", "ammo pack": "item_pack", "health": "item_health", "mega health": "item_health_mega",
    "bullets": "ammo_bullets", "shells": "ammo_shells", "cells": "ammo_cells", "slugs": "ammo_slugs", "rockets": "ammo_rockets", "grenades": "ammo_grenades",
}
ITEMS = tuple(PICKUP_ITEMS.values())

# Muzzle-flash numbers and view-model words of weapons.
FLASH_WEAPONS = {
    0: "blaster", 1: "machinegun", 2: "shotgun", 3: "chaingun", 4: "chaingun", 5: "chaingun", 6: "railgun", 7: "rocketlauncher", 8: "grenadelauncher", 12: "bfg",
    13: "supershotgun", 14: "hyperblaster",
}
VIEW_WEAPONS = {
    "blast": "blaster", "shotg": "shotgun", "shotg2": "supershotgun", "machn": "machinegun", "chain": "chaingun", "handgr": "handgrenade", "launch": "grenadelauncher",
    "rocket": "rocketlauncher", "hyperb": "hyperblaster", "rail": "railgun", "bfg": "bfg",
}
WEAPONS = tuple(VIEW_WEAPONS.values())


def item_of_model(path: Column | str) -> Column:
    """The item that a world model's path stands for, else null: weapons, ammunition, armour and healing by their folders."""
    c = col(path)
    # Words of world models that differ from the item's name.
    weapon = {"rail": "railgun", "chain": "chaingun", "rocket": "rocketlauncher", "shotg2": "supershotgun", "hyperb": "hyperblaster", "launch": "grenadelauncher", "shotg": "shotgun", "machn": "machinegun", "bfg": "bfg"}
    table = F.create_map(*(F.lit(x) for kv in weapon.items() for x in kv))
    word = lambda pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("weapon_"), F.element_at(table, word(r"^models/weapons/g_([a-z0-9]+)/tris\.md2$"))),
        F.concat(F.lit("ammo_"), word(r"^models/items/ammo/(bullets|shells|cells|slugs|rockets|grenades)/medium/tris\.md2$")),
        F.concat(F.lit("item_armor_"), word(r"^models/items/armor/(body|combat|jacket|shard)/tris\.md2$")),
        F.when(c.rlike(r"^models/items/healing/(stimpack|medium|large)/tris\.md2$"), "item_health"),
        F.when(c == "models/items/mega_h/tris.md2", "item_health_mega").when(c == "models/items/adrenal/tris.md2", "item_adrenaline").when(c == "models/items/pack/tris.md2", "item_pack"),
    )


def view_weapon(path: Column | str) -> Column:
    """The weapon of a view model's path (models/weapons/v_x/tris.md2), else null."""
    table = F.create_map(*(F.lit(x) for kv in VIEW_WEAPONS.items() for x in kv))
    return F.element_at(table, F.nullif(F.regexp_extract(col(path), r"^models/weapons/v_([a-z0-9]+)/tris\.md2$", 1), F.lit("")))


def flash_weapon(flash: Column | str) -> Column:
    """The weapon of a muzzle flash's low seven bits, else null."""
    table = F.create_map(*(F.lit(x) for kv in FLASH_WEAPONS.items() for x in kv))
    return F.element_at(table, col(flash).bitwiseAND(F.lit(127)))


def pickup_item(name: Column | str) -> Column:
    """The item of a HUD pickup name, whatever its case; unknown for other names, null for none."""
    table = F.create_map(*(F.lit(x) for kv in PICKUP_ITEMS.items() for x in kv))
    name = F.nullif(F.trim(col(name)), F.lit(""))
    return F.when(name.isNotNull(), F.coalesce(F.element_at(table, F.lower(name)), F.lit("unknown")))


def low_seven(c: Column | str) -> Column:
    """Code points below 256 lose their high bit; others stay. The 128 that change are listed by rule."""
    high = "".join(chr(i) for i in range(128, 256))
    return F.translate(col(c), high, "".join(chr(i & 127) for i in range(128, 256)))


def identity_name(c: Column | str) -> Column:
    """7-bit mask, colour codes (^digit) out, trimmed, lower-cased; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(low_seven(c)), r"\^[0-9]", "")), F.lit(""))


def identity(aliases: Column | str, known: dict[str, str] | None = None) -> Column:
    """The one normalised name that all aliases agree on, through an optional table of known names; else null."""
    names = F.filter(F.transform(col(aliases), identity_name), lambda x: x.isNotNull())
    if known:
        table = F.create_map(*(F.lit(x) for kv in sorted(known.items()) for x in kv))
        names = F.transform(names, lambda x: F.coalesce(F.element_at(table, x), x))
    names = F.array_distinct(names)
    return F.when(F.size(names) == 1, F.element_at(names, 1))


def console_name(c: Column | str) -> Column:
    """7-bit mask, ASCII lower case, control characters out, spaces and tabs trimmed, at most 15 characters."""
    plain = F.translate(low_seven(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.substring(F.regexp_replace(F.regexp_replace(plain, r"[\x00-\x1F\x7F]", ""), r"^[ \t]+|[ \t]+$", ""), 1, 15)


_SEVEN_BITS = {i: i & 127 for i in range(128, 256)}


def nickname_of(name: str) -> str:
    """T1 for one string: what is left of it, letters and digits only, after its bytes lose their high bit, colour codes (a
    caret and a digit) go, and compatible forms and case are folded."""
    out, skip = [], False
    plain = name.translate(_SEVEN_BITS)
    for c, following in zip(plain, plain[1:] + " "):
        if skip:
            skip = False
        elif c == "^" and following in "0123456789":
            skip = True
        else:
            out.append(c)
    decomposed = unicodedata.normalize("NFKD", "".join(out))
    return "".join(c for c in decomposed.casefold() if c.isalnum())


@F.pandas_udf(StringType())
def _nickname_unicode(s: pd.Series) -> pd.Series:
    return s.map(nickname_of, na_action="ignore")


def nickname_ascii(c: Column | str) -> Column:
    """T1 for strings without characters above 255: after the mask only ASCII is left."""
    return F.regexp_replace(F.regexp_replace(F.lower(low_seven(c)), r"\^[0-9]", ""), r"[^a-z0-9]", "")


def nickname(c: Column | str) -> Column:
    """Strings above U+00FF go through Python's Unicode tables; the others never leave the JVM."""
    c = col(c)
    return F.when(c.rlike(r"[^\x{0}-\x{FF}]"), _nickname_unicode(F.when(c.rlike(r"[^\x{0}-\x{FF}]"), c))).otherwise(nickname_ascii(c))


def payload(c: Column | str, fields: str) -> Column:
    """The named fields of a JSON object as a struct (a DDL schema); broken JSON and absent fields are null."""
    return F.from_json(col(c), fields)


def name_close(actual: Column, wanted: Column) -> Column:
    """T4 for one normalised name: equal; contained with at most 8 more characters; or one typo in a long name."""
    n = F.length(wanted)
    inside = (n >= 5) & actual.contains(wanted) & (F.length(actual) <= n + 8)
    typo = (n >= 6) & (F.abs(F.length(actual) - n) <= 1) & F.levenshtein(actual, wanted, 1).between(0, 1)
    return F.when(n == 0, False).when(n < 3, actual == wanted).otherwise((actual == wanted) | inside | typo)


def donor_match(aliases: Column | str, wanted: Column) -> Column:
    """T4: whether every (normalised) alias is close to the wanted name; no aliases match nothing."""
    return (F.size(col(aliases)) > 0) & F.forall(col(aliases), lambda a: name_close(a, wanted))


def is_obituary(line: Column | str) -> Column:
    """T5: not in parentheses, no "name: " in the first 24 characters, and one of the phrases."""
    c = col(line)
    says = F.instr(F.substring(c, 1, 24), ": ") > 0
    return ~c.startswith("(") & ~says & c.rlike("|".join(map(re.escape, OBITUARY_PHRASES)))


def obituary_names(line: Column | str, roster: Column | str) -> Column:
    """(victim, killer): of the roster's names of 3 or more characters, where each first stands in the line,
    those within no longer one; exactly two must be left, in that order, else null."""
    line = col(line)
    here = F.transform(col(roster), lambda n: F.struct(F.instr(line, n).alias("at"), (F.instr(line, n) + F.length(n)).alias("end"), n.alias("name")))
    here = F.filter(here, lambda x: (F.length(x["name"]) >= 3) & (x["at"] > 0))
    longer = lambda x: lambda y: (y["at"] <= x["at"]) & (y["end"] >= x["end"]) & (F.length(y["name"]) > F.length(x["name"]))
    two = F.array_sort(F.filter(here, lambda x: ~F.exists(here, longer(x))))
    return F.when(F.size(two) == 2, F.struct(F.get(two, 0)["name"].alias("victim"), F.get(two, 1)["name"].alias("killer")))


def obituary_weapon(line: Column | str) -> Column:
    """The weapon of the first phrase, in order, that the line has; null without one."""
    return F.coalesce(*(F.when(col(line).contains(phrase), weapon) for phrase, weapon in OBITUARY_WEAPONS))


def map_name(path: Column | str) -> Column:
    """X of maps/x.bsp, else null."""
    return F.nullif(F.regexp_extract(col(path), r"^maps/(.+)\.bsp$", 1), F.lit(""))


def category(classname: Column | str) -> Column:
    """An entity class's category; the first rule that fits counts."""
    c = col(classname)
    return (
        F.when(c.startswith("weapon_"), "weapon")
        .when(c.startswith("ammo_"), "ammo")
        .when(c.contains("armor"), "armor")
        .when(c.startswith("item_health") | (c == "item_adrenaline"), "health")
        .when(c.isin("item_pack", "item_bandolier"), "capacity")
        .otherwise("other")
    )


def entity_blocks(text: Column | str) -> Column:
    """The key/value maps of an entity string's { "k" "v" ... } blocks; of repeated keys the last counts."""
    pair = r'"([^"]*)"\s*"([^"]*)"'

    def block(b):
        keys, values = F.regexp_extract_all(b, F.lit(pair), F.lit(1)), F.regexp_extract_all(b, F.lit(pair), F.lit(2))
        both = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
        last = F.filter(F.transform(both, lambda x, i: F.struct(x["k"].alias("k"), x["v"].alias("v"), i.alias("i"))), lambda x: ~F.array_contains(F.slice(keys, x["i"] + 2, F.size(keys)), x["k"]))
        return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))

    return F.transform(F.regexp_extract_all(col(text), F.lit(r"\{([^{}]*)\}"), F.lit(1)), block)


def escaped_json_string(c: Column | str) -> Column:
    """A JSON string literal as ASCII: quotes, backslashes and control characters escaped, others as \\uXXXX."""
    return _ascii_json(col(c))


@F.pandas_udf(StringType())
def _ascii_json(s: pd.Series) -> pd.Series:
    return s.map(json.dumps, na_action="ignore")


@F.pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON text with sorted keys, no spaces and ASCII escapes; NaN and broken text become null."""

    def one(t):
        try:
            return json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), allow_nan=False)
        except ValueError:
            return None

    return s.map(one, na_action="ignore")
