"""Text expressions: keyword classifiers, JSON out of prose, similarity, rendered advice."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import vocab as V
from tickloom.functions.encode import money_bucket, weapon_bucket
from tickloom.session import stored


def words(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in items])


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def hits(low: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur in a lower-cased text.

    A plain sum of ``contains``, so it is compiled. Lower-case once, in a projection of
    its own: an inlined ``lower`` would run again for every keyword.
    """
    return total([low.contains(k).cast("int") for k in keywords])


def mentions(low: Column, groups: dict[str, Sequence[str]]) -> Column:
    """Sorted names of the groups with at least one keyword in a lower-cased text."""
    found = [F.when(reduce(lambda a, b: a | b, [low.contains(k) for k in groups[g]]), F.lit(g)) for g in sorted(groups)]
    return F.array_compact(F.array(*found))


def movement_of(advance: Column, retreat: Column, hold: Column) -> Column:
    """1 advance, -1 retreat, 0 hold by the largest count (ties in that order); null when all are 0."""
    best = F.greatest(advance, retreat, hold)
    return F.when(best == 0, None).when(advance == best, 1).when(retreat == best, -1).otherwise(0)


def objective_of(toward: Column, away: Column) -> Column:
    """1 toward, -1 away, 0 when both are mentioned equally, null without any."""
    return F.when(toward > away, 1).when(away > toward, -1).when(toward > 0, 0)


def starts_of(start: Column, wait: Column) -> Column:
    """True/false by the larger count, null on a draw."""
    return F.when(start > wait, True).when(wait > start, False)


FULL_LISTS = {
    "advance": V.ADVANCE_WORDS, "retreat": V.RETREAT_WORDS, "hold": V.HOLD_WORDS, "toward": V.TOWARD_WORDS, "away": V.AWAY_WORDS,
    "start": V.INITIATE_WORDS, "wait": V.WAIT_WORDS,
}
LIGHT_LISTS = {
    "advance": V.LIGHT_ADVANCE, "retreat": V.LIGHT_RETREAT, "hold": V.LIGHT_HOLD, "toward": V.LIGHT_TOWARD, "away": V.LIGHT_AWAY,
    "start": V.LIGHT_INITIATE, "wait": V.LIGHT_WAIT, "utility": V.LIGHT_UTILITY,
}


def with_counts(df: DataFrame, column: str, lists: dict[str, Sequence[str]], prefix: str = "__kw_") -> DataFrame:
    """One keyword count per list. Counted in a projection of its own, so each is computed once per row."""
    counts = {prefix + n: hits(F.col("__low"), ws) for n, ws in lists.items()}
    return df.withColumn("__low", F.lower(column)).withColumns(counts)


def with_movement(df: DataFrame, column: str, advance: Sequence[str], retreat: Sequence[str], hold: Sequence[str], name: str = "movement") -> DataFrame:
    counted = with_counts(df, column, {"a": advance, "r": retreat, "h": hold})
    parts = ["__kw_a", "__kw_r", "__kw_h"]
    return counted.withColumn(name, movement_of(*[F.col(c) for c in parts])).drop(*parts, "__low")


def with_behaviour(df: DataFrame, column: str, name: str = "behaviour", light: bool = False) -> DataFrame:
    """Behaviour struct read from advice text.

    What the text does not say stays null; the ``light`` variant uses shorter lists and
    fills every field.
    """
    lists = LIGHT_LISTS if light else FULL_LISTS
    counted = with_counts(df, column, lists)
    k = {n: F.col(f"__kw_{n}") for n in lists}
    move, goal = movement_of(k["advance"], k["retreat"], k["hold"]), objective_of(k["toward"], k["away"])
    if light:
        starts = k["start"] > k["wait"]
        fields = {
            "movement_direction": F.coalesce(move, F.lit(0)),
            "objective_direction": F.coalesce(goal, F.lit(0)),
            "utility_count": F.least(k["utility"], F.lit(4)),
            "initiated_engagement": starts,
            "engagement_delay": F.when(starts, 0.2).otherwise(0.8),
        }
    else:
        starts = starts_of(k["start"], k["wait"])
        fields = {
            "movement_direction": move,
            "objective_direction": goal,
            "utility_used": mentions(F.col("__low"), V.UTILITY_WORDS),
            "initiated_engagement": starts,
            "engagement_delay": F.when(starts, 0.2).when(~starts, 0.8),
        }
    return counted.withColumn(name, F.struct(*[e.alias(n) for n, e in fields.items()])).drop("__low", *[f"__kw_{n}" for n in lists])


def read_once(df: DataFrame, column: str, read: Callable[[DataFrame], DataFrame], limit: int = 8 << 20) -> DataFrame:
    """``read`` applied to each distinct text of a column, joined back: templated texts repeat far more often than they differ.

    What was read is stored; up to ``limit`` bytes of texts it is sent to the tasks, beyond that it is joined by a shuffle.
    """
    known = stored(read(df.select(F.col(column).alias("__text")).distinct().withColumn(column, F.col("__text"))).drop(column), "texts")
    size = known.agg(F.sum(F.coalesce(F.octet_length("__text"), F.lit(0)) + 100)).first()[0] or 0
    return df.join(F.broadcast(known) if size <= limit else known, F.col(column).eqNullSafe(F.col("__text")), "left").drop("__text")


def with_categories(df: DataFrame, column: str, name: str = "categories", groups: dict[str, Sequence[str]] = V.ACTION_WORDS) -> DataFrame:
    """Sorted action categories a text mentions."""
    return df.withColumn("__low", F.lower(column)).withColumn(name, mentions(F.col("__low"), groups)).drop("__low")


# How an object is found in a response.
FENCED_OBJECT = r"```(?:json)?\s*(\{[\s\S]*?\})\s*```"
OUTER_OBJECT = r"\{[\s\S]*\}"
SPACES = " \t\n\r\f\v"


def json_object(text: Column) -> Column:
    """The first parseable object of a response: fenced block, else the outermost braces, else null."""

    def valid(candidate):
        return F.when((candidate != "") & F.try_parse_json(candidate).isNotNull(), candidate)

    return F.coalesce(valid(F.regexp_extract(text, FENCED_OBJECT, 1)), valid(F.regexp_extract(text, OUTER_OBJECT, 0)))


def strip_fence(text: Column) -> Column:
    """Of a text that opens with a fence the first fenced part that starts with a brace (a leading ``json`` apart), else the trimmed text."""
    whole = F.trim(text, F.lit(SPACES))
    parts = F.transform(F.split(whole, "```"), lambda p: F.trim(F.regexp_replace(F.trim(p, F.lit(SPACES)), r"\Ajson", ""), F.lit(SPACES)))
    body = F.get(F.filter(parts, lambda p: F.startswith(p, F.lit("{"))), F.lit(0))
    return F.when(F.startswith(whole, F.lit("```")), F.coalesce(body, whole)).otherwise(whole)


def format_gate(text: Column, sections: Sequence[str] = ("game_state", "analysis", "advice")) -> Column:
    """1.0 when the response holds an object with all sections as objects, else 0.0."""
    found = json_object(text)
    checks = [F.coalesce(F.get_json_object(found, f"$.{s}").startswith("{"), F.lit(False)) for s in sections]
    ok = checks[0]
    for c in checks[1:]:
        ok = ok & c
    return F.when(ok, 1.0).otherwise(0.0)


def percent(text: Column) -> Column:
    """First 'NN%' figure of a text as a double."""
    digits = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*%", 1)
    return F.when(digits != "", digits.cast("double"))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams; a text shorter than three characters stands for itself.

    Characters are listed once and joined by position: taking a substring per position would
    count from the start of a UTF-8 text every time. The list is bound to a name, because an
    expression that a lambda reads is worked out again wherever it stands.
    """

    def triples(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(chars) - 3), lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)))

    n = F.length(text)
    whole = F.transform(F.array(F.split(text, "")), triples)[0]
    return F.array_distinct(F.when(n >= 3, whole).when(n > 0, F.array(text)).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two distinct-element arrays; 1.0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def informativeness(reward_gap: Column, similarity: Column) -> Column:
    """Half for close rewards, half for different texts, 6 decimals; an unknown gap counts as 1."""
    gap = F.coalesce(F.abs(reward_gap), F.lit(1.0))
    return F.round(0.5 * (1 - F.least(gap, F.lit(1.0))) + 0.5 * F.greatest(F.lit(0.0), 1 - similarity), 6)


def block_text(blocks: Column, limit: int | None = None) -> Column:
    """Text blocks of a prompt array joined by spaces; ``limit`` is for summaries only."""
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), " ")
    return joined if limit is None else F.substring(joined, 1, limit)


def flat_text(values: Column) -> Column:
    """All strings of a string map joined by spaces, in key order."""
    keys = F.array_sort(F.map_keys(values))
    return F.array_join(F.transform(keys, lambda k: F.element_at(values, k)), " ")


def canonical_json(struct_fields: dict[str, Column], drop: Sequence[str] = ()) -> Column:
    """JSON text of the fields in name order, without the dropped ones."""
    kept = [struct_fields[n].alias(n) for n in sorted(struct_fields) if n not in drop]
    return F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})


def unordered_pair(stem: Column) -> Column:
    """'b-vs-a-m1-x' as 'a-vs-b-m1-x'; other names unchanged."""
    pattern = r"^(.+?)-vs-(.+?)-(m\d+-.+)$"
    first, second, rest = (F.regexp_extract(stem, pattern, i) for i in (1, 2, 3))
    teams = F.array_sort(F.array(first, second))
    return F.when(F.regexp_like(stem, F.lit(pattern)), F.concat_ws("-", F.array_join(teams, "-vs-"), rest)).otherwise(stem)


def team_key(stem: Column, fixes: dict[str, str] | None = None) -> Column:
    """Canonical team pair without the map suffix, with named corrections."""
    pair = F.regexp_replace(unordered_pair(stem), r"-m\d+-\w+$", "")
    for wrong, right in (fixes or {}).items():
        pair = F.when(pair == wrong, right).otherwise(pair)
    return pair


def messages(system: Column, images: Column, text: Column, answer: Column | None = None) -> Column:
    """Chat rows: system, user (images oldest first, then the text) and, when given, the answer."""

    def part(kind, value):
        return F.struct(F.lit(kind).alias("type"), value.alias("value"))

    user = F.concat(F.transform(images, lambda i: part("image", i)), F.array(part("text", text)))
    rows = [F.struct(F.lit("system").alias("role"), F.array(part("text", system)).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))]
    if answer is not None:
        rows.append(F.struct(F.lit("assistant").alias("role"), F.array(part("text", answer)).alias("content")))
    return F.array(*rows)


# ---- described actions and templated advice --------------------------------------------


def listed(*choices) -> Column:
    """Array of the values whose condition holds, in order: ``(condition, value)`` pairs."""
    return F.array_compact(F.array(*[F.when(c, v if isinstance(v, Column) else F.lit(v)) for c, v in choices]))


def described_action(move: Column, objective_dir: Column, used: Column, initiated: Column, side: Column) -> dict[str, Column]:
    """Coarse categories and a description of what a player did."""
    ct, some = side == "ct", F.size(used) > 0
    toward, away = objective_dir == 1, objective_dir == -1
    cats = F.concat(
        F.array(F.when(move == 1, "aggressive").when(move == -1, "fall_back").otherwise("hold")),
        listed((toward & ct | away & ~ct, "rotate"), (some, "utility"), (initiated, "engage")),
    )
    parts = F.concat(
        F.array(F.when(move == 1, "pushed toward enemies").when(move == -1, "fell back from enemies").otherwise("held position")),
        listed(
            (toward & ct, "moved toward bomb"),
            (toward & ~ct, "stayed near bomb"),
            (away & ct, "moved away from bomb"),
            (away & ~ct, "moved away from planted bomb"),
            (some, F.concat(F.lit("used "), F.array_join(used, ", "))),
            (initiated, "initiated engagement"),
        ),
    )
    return {"categories": cats, "description": F.array_join(parts, "; ")}


def advice(c=F.col) -> dict[str, Column]:
    """Templated situation, threats, chances, action, reasoning, fallback and callout of a state."""
    mates, foes, side, bomb = c("alive_teammates"), c("alive_enemies"), c("player_side"), c("bomb_status")
    hp, money, own = c("player_health"), c("player_money"), c("alive_teammates") + 1
    planted, t_side = bomb == "planted", side == "T"
    ct_side = ~t_side
    fmt = F.format_string
    mates_s = F.when(mates != 1, "teammates").otherwise("teammate")
    util = F.coalesce(c("utility"), F.array().cast("array<string>"))
    situation = (
        F.when(planted & t_side, fmt("%dv%d post-plant situation, T-side defending planted bomb with %d %s alive", own, foes, mates, mates_s))
        .when(planted, fmt("%dv%d post-plant situation, CT-side rushing defuse with %d %s alive", foes, own, mates, mates_s))
        .when(c("round_phase") == "freezetime", fmt("Freeze time — round about to begin, %dv%d start", own, foes))
        .when(own == foes, fmt("%dv%d even fight, bomb %s, %d %s supporting", own, foes, bomb, mates, mates_s))
        .when(own > foes, fmt("%dv%d man-advantage (+%d), bomb %s, opportunity to press", own, foes, own - foes, bomb))
        .otherwise(fmt("%dv%d man-disadvantage (-%d), bomb %s, must play carefully", own, foes, foes - own, bomb))
    )
    threats = F.when(foes == 0, F.array(F.lit("No active threats — round likely decided"))).otherwise(
        listed(
            (foes >= 4, fmt("High enemy count (%d active) — multiple angles to watch", foes)),
            ((foes >= 2) & (foes < 4), fmt("%d enemies still active — coordinated push possible", foes)),
            (foes < 2, "1 enemy remaining — likely playing for information or time"),
            (planted & (side == "CT"), "Bomb planted — time pressure to defuse before detonation"),
            (planted & t_side, "Bomb planted — enemy will attempt defuse, cover site"),
            (hp < 50, fmt("Low HP (%d) — one shot from most weapons is lethal", hp)),
        )
    )
    chances = listed(
        (own > foes, fmt("Numerical advantage (%dv%d) — trade efficiently and press", own, foes)),
        (own == foes, "Equal numbers — isolated duels favor better-positioned player"),
        (own < foes, fmt("Outnumbered %dv%d — look for off-angles and information plays", own, foes)),
        (F.size(util) > 0, fmt("Utility available: %s — use proactively", F.array_join(util, ", "))),
        (F.size(util) == 0, "No utility — rely on positioning and crossfire"),
        ((bomb == "carried") & t_side & (foes <= 2), "Low enemy count — safe window to plant bomb and play retake"),
        (planted & t_side, "Bomb planted — hold passive angles and let clock work"),
    )
    action = (
        F.when(planted & t_side, "Hold passive angle near bomb to deny defuse attempts")
        .when(planted & (own >= foes), "Clear site aggressively and secure defuse with teammate cover")
        .when(planted, "Attempt lone-wolf defuse — distract enemies, fake defuse if needed")
        .when(hp < 50, "Play defensively — get traded out or fall back for recovery")
        .when(own > foes + 1, "Execute coordinated site take with remaining utility")
        .when(own == foes, "Hold position and play for picks — look for isolated duels")
        .otherwise("Stall for time — play off-angles and avoid direct confrontation")
    )
    reasoning = F.concat_ws(
        " ",
        fmt("Numbers are %dv%d.", own, foes),
        fmt("Economy is %s (%d credits).", money_bucket(money), money),
        fmt("Weapon loadout: %s.", weapon_bucket(c("weapon_primary"))),
        F.when(planted, "With bomb planted, clock is the primary factor.")
        .when(own > foes, "Numerical advantage allows for aggressive plays.")
        .when(own < foes, "Numerical disadvantage requires passive, information-based play."),
    )
    fallback = (
        F.when(planted & (side == "CT"), "If defuse is impossible, trade kills to deny bomb plant next round economy")
        .when((own <= 1) & (foes >= 2), "If trade opportunity appears, accept it — dying with value is better than losing 1v2+")
        .when(own > foes, "If execute fails, reset and re-enter from different angle")
        .otherwise("Fall back to safer position and wait for teammate assistance")
    )
    callout = (
        F.when(mates == 0, fmt("Lone survivor: %d remaining — report position via ping", foes))
        .when(planted, fmt("Bomb planted — %d with me, %d enemies. Hold site exits.", mates, foes))
        .when(own > foes, fmt("%d with me, %d enemies. Push together and trade fast.", mates, foes))
        .otherwise(fmt("%d with me, %d enemies. Play slow, gather info.", mates, foes))
    )
    return {
        "situation_summary": situation,
        "immediate_threats": threats,
        "opportunities": chances,
        "primary_action": action,
        "reasoning": reasoning,
        "fallback": fallback,
        "callout": callout,
    }


def contrast_texts(c=F.col) -> dict[str, Column]:
    """A matching, an opposite and a generic candidate text for a state and its behaviour.

    Reads ``categories``, ``movement_direction``, ``objective_direction``,
    ``initiated_engagement``, ``utility_used`` and the state columns.
    """
    cats = F.lower(F.array_join(c("categories"), " "))
    move, goal, starts = c("movement_direction"), c("objective_direction"), c("initiated_engagement")
    own, foes = c("alive_teammates") + 1, c("alive_enemies")

    def has(word):
        return cats.contains(word)

    pushing = has("execute") | has("push") | (move == 1)
    matching = (
        F.when(pushing, "Push and look for entry")
        .when(has("rotate") & (goal > 0), "Rotate toward the bomb")
        .when(has("rotate") & (goal < 0), "Rotate away from the bomb to find a flank angle")
        .when(has("hold") & starts, "Hold your angle but be ready to take a fight if they push")
        .when(has("hold"), "Hold your post-plant angle and don't reposition unnecessarily")
        .when(has("retreat") | has("save") | (move == -1), "Disengage and save for the next round")
        .when(has("engage") & starts, "Take the first shot — initiate the engagement")
        .when(has("engage"), "Be patient but don't refuse a clean trade")
        .otherwise("Play this slow and follow your teammate's lead")
    )
    opposite = (
        F.when(pushing, "Stop pushing and pull back to spawn")
        .when(has("hold"), "Don't sit here — rush forward and try to get a pick before they set up")
        .when(has("rotate") & (goal > 0), "Stay where you are; don't rotate toward the bomb, you'll get traded")
        .when(has("rotate") & (goal < 0), "Push directly onto the bomb and look for the defuse")
        .when(has("retreat") | has("save"), "Don't save — push out and contest with what you have")
        .when(has("engage") & starts, "Don't take a fight here; disengage and play passive")
        .otherwise("Stop playing passive and force the action")
    )
    numbers = F.format_string(
        "%s %dv%d", F.when(own > foes, "You're up").when(own < foes, "You're down").otherwise("It's a"), own, foes
    )
    clock = F.when(
        c("bomb_status") == "planted", "the bomb is planted, so time pressure is on CT to retake"
    ).when((c("round_phase") == "post-plant") & (F.lower(c("player_side")) == "t"), "you've planted, so time is on your side")
    tools = F.when(
        F.size(c("utility_used")) > 0,
        F.concat(F.lit("use your "), F.lower(F.array_join(c("utility_used"), ", ")), F.lit(" to support the play")),
    )
    return {
        "A_correct": F.concat(matching, F.lit(". "), F.concat_ws("; ", numbers, clock, tools), F.lit(".")),
        "B_anti_pro": F.concat(
            opposite, F.lit(". "), F.concat_ws("; ", numbers, F.lit("you have to make something happen, time isn't on your side")), F.lit(".")
        ),
        "C_generic": F.lit(V.GENERIC_ADVICE),
    }


def briefing(c=F.col) -> Column:
    """Multi-line briefing of a state; unknown values show as '?'."""

    def show(name):
        return F.coalesce(c(name).cast("string"), F.lit("?"))

    util = F.when(F.size(c("utility")) > 0, F.array_join(c("utility"), ", ")).otherwise("none")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Map: "), F.replace(show("map_name"), F.lit("de_"), F.lit(""))),
        F.concat(F.lit("Phase: "), show("round_phase")),
        F.concat(F.lit("Your side: "), show("player_side")),
        F.concat(F.lit("Your health: "), show("player_health"), F.lit(" | armor: "), show("player_armor")),
        F.concat(F.lit("Your money: $"), show("player_money")),
        F.concat(F.lit("Your weapons: "), show("weapon_primary"), F.lit(" / "), show("weapon_secondary")),
        F.concat(F.lit("Your utility: "), util),
        F.concat(F.lit("Teammates alive (incl. you): "), show("alive_teammates")),
        F.concat(F.lit("Enemies alive: "), show("alive_enemies")),
        F.concat(F.lit("Bomb: "), show("bomb_status")),
        F.concat(F.lit("Enemies currently visible to you: "), show("visible_enemies")),
    )


def picked(options: Sequence[str | Column], *key: Column, seed: int = 0) -> Column:
    """One of the options, chosen by the SHA-256 of ``key`` and ``seed`` joined by colons (its first eight hex digits)."""
    array = F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options])
    digest = F.sha2(F.concat_ws(":", *[k.cast("string") for k in key], F.lit(str(seed))), 256)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.element_at(array, (number % len(options) + 1).cast("int"))


def value_phrase(percent_ct: Column, *key: Column) -> Column:
    """Who is favoured, from the win percentage of the CT side."""
    side, edge = F.when(percent_ct >= 50, "CT").otherwise("T"), F.abs(percent_ct - 50)

    def say(*templates):
        return picked([F.format_string(x, side) if "%s" in x else F.lit(x) for x in templates], *key, seed=1)

    phrase = (
        F.when(edge < 6, say("the round is roughly even", "this is close to a coin-flip", "neither side holds a clear edge"))
        .when(edge < 18, say("%s is modestly favoured", "%s holds a slight edge", "the model leans %s"))
        .otherwise(say("%s is in a strong position", "%s is clearly favoured", "the model reads this as a %s-sided round"))
    )
    return F.concat(phrase, F.format_string(" (CT win probability ~%.0f%%)", percent_ct))


def trend_phrase(now: Column, later: Column, *key: Column) -> Column:
    """Sentence on a change of at least three points, else empty."""
    drift = F.when(later > now, "edge up slightly").otherwise("soften slightly")
    said = picked(
        [
            F.format_string(" The model expects CT's read to %s over the next few seconds.", drift),
            F.format_string(" Over the next few seconds the model sees this %s.", drift),
        ],
        *key,
        seed=2,
    )
    return F.when(F.abs(later - now) < 3, "").otherwise(said)


def resultant(bearings: Column) -> Column:
    """Mean resultant length of an array of bearings: 1 all alike, 0 scattered."""

    def mean(f):
        return F.aggregate(bearings, F.lit(0.0), lambda acc, b: acc + f(b)) / F.size(bearings)

    return F.hypot(mean(F.cos), mean(F.sin))


def team_clause(team: str, movers: Column, fast_bearings: Column, *key: Column) -> Column:
    """What one side is expected to do, from its movers and the bearings of the fast ones."""
    fast = F.size(fast_bearings)
    noun = F.when(movers > 1, f"{team} players").otherwise(f"{team} player")

    def say(*options):
        return picked(options, *key, F.lit(team), seed=3)

    return (
        F.when(movers == 0, say(f"{team} to hold position", f"{team} to stay put"))
        .when(
            (fast >= 2) & (resultant(fast_bearings) > 0.6),
            say(F.format_string(f"a coordinated {team} push (%d players)", fast), F.format_string(f"%d {team} players pushing together", fast)),
        )
        .when(
            fast >= 2,
            say(F.format_string(f"%d {team} players pushing from spread positions", fast), F.format_string(f"scattered fast movement from %d {team} players", fast)),
        )
        .otherwise(say(F.format_string("%d %s repositioning", movers, noun), F.format_string("%d %s on the move", movers, noun)))
    )
