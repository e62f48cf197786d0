"""Inventory lists to categories, prices and buy levels, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions import vocab as V
from tickloom.functions.encode import lookup

CATEGORY_OF = {item: cat for cat, items in V.ITEM_CATEGORIES.items() for item in items}


def category(item: Column) -> Column:
    return lookup(CATEGORY_OF, item, "other")


def holds(inventory: Column, cat: str) -> Column:
    """Whether any item of a category is in the inventory."""
    items = F.array(*[F.lit(i) for i in V.ITEM_CATEGORIES[cat]])
    return F.coalesce(F.arrays_overlap(inventory, items), F.lit(False))


def first_of(checks: dict[str, Column], default: str = "other") -> Column:
    """Name of the first check that holds, in the order given."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in checks.items()], F.lit(default))


def first_held(values: Column, order: list[str], default: str = "other") -> Column:
    """The first entry of ``order`` that is present in an array."""
    return first_of({x: F.array_contains(values, x) for x in order}, default)


def loadout(inventory: Column) -> dict[str, Column]:
    """Primary, secondary, bomb flag and utility bits of an inventory.

    Membership tests against each category's items: compiled, and an evaluation stops at the
    first category of the priority that is held.
    """
    bits = {f"util_{u}": holds(inventory, u).cast("double") for u in V.UTILITY_BITS}
    return {
        "primary": first_of({c: holds(inventory, c) for c in V.PRIMARY_ORDER}),
        "secondary": first_of({c: holds(inventory, c) for c in V.SECONDARY_ORDER}),
        "has_c4": holds(inventory, "c4").cast("double"),
    } | bits


def item_kind(item: Column) -> Column:
    """primary / secondary / utility / bomb / melee; unknown names match by containment either way."""

    def among(words):
        return item.isin(*words)

    def fuzzy(words):
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: item.contains(w) | w.contains(item))

    melee = item.contains("Knife") | item.contains("Bayonet") | item.contains("Dagger")
    return (
        F.when(among(V.PRIMARY_ITEMS), "primary")
        .when(among(V.SECONDARY_ITEMS), "secondary")
        .when(among(V.UTILITY_ITEMS), "utility")
        .when(item.contains("C4"), "bomb")
        .when(melee, "melee")
        .when(fuzzy(V.PRIMARY_ITEMS), "primary")
        .when(fuzzy(V.SECONDARY_ITEMS), "secondary")
        .when(fuzzy(V.UTILITY_ITEMS), "utility")
        .otherwise("melee")
    )


def weapon_class(inventory: Column) -> Column:
    """Class of the most valuable weapon class held; 'pistol' when there is none."""
    ranks = F.transform(inventory, lambda i: lookup(V.CLASS_PRIORITY, lookup(V.WEAPON_CLASSES, i), 0))
    by_rank = {rank: name for name, rank in V.CLASS_PRIORITY.items()}
    return lookup(by_rank, F.array_max(ranks), "pistol")


def parsed(inventory: Column) -> dict[str, Column]:
    """First primary, first secondary and all utility items, in inventory order."""

    def of(kind):
        return F.filter(inventory, lambda i: item_kind(i) == kind)

    return {
        "weapon_primary": F.try_element_at(of("primary"), F.lit(1)),
        "weapon_secondary": F.try_element_at(of("secondary"), F.lit(1)),
        "utility": F.coalesce(of("utility"), F.array().cast("array<string>")),
    }


def equipment_value(inventory: Column, armor: Column, helmet: Column) -> Column:
    prices = F.transform(F.coalesce(inventory, F.array().cast("array<string>")), lambda i: lookup(V.ITEM_PRICES, i, 0))
    items = F.aggregate(prices, F.lit(0), lambda acc, p: acc + p)
    worn = F.when(F.coalesce(armor, F.lit(0)) > 0, V.VEST_PRICE + F.when(helmet, V.HELMET_PRICE).otherwise(0)).otherwise(0)
    return (items + worn).cast("long")


def buy_level(average: Column) -> Column:
    """eco / force / half / full from the average equipment value."""
    level = F.lit("eco")
    for floor, name in reversed(V.BUY_LEVELS):
        level = F.when(average >= floor, name).otherwise(level)
    return level


def team_buy(players: Column, total: Column, alive: Column) -> Column:
    """Long label of a side; ``total`` counts everybody, the average only the living."""
    short = buy_level(total / alive)
    return F.when(players == 0, "unknown").when(alive == 0, "eliminated").when(short == "eco", "eco").otherwise(F.concat(short, F.lit("-buy")))


def matchup(t_buy: Column, ct_buy: Column) -> Column:
    """Both buy levels, weaker first; 'mirror_…' when equal."""

    def strength(b):
        return lookup(V.BUY_STRENGTH, b, 0)

    weak_first = strength(t_buy) < strength(ct_buy)
    return (
        F.when(t_buy == ct_buy, F.concat(F.lit("mirror_"), t_buy))
        .when(weak_first, F.concat_ws("_vs_", t_buy, ct_buy))
        .otherwise(F.concat_ws("_vs_", ct_buy, t_buy))
    )
