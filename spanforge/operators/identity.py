"""Teams, colours and ids: resolving names against the game table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import color_tokens, colors_match, teams_match


def team_map(games: DataFrame) -> DataFrame:
    """Two rows per game: the team, the goalie colour it threatens, and flags.

    A team threatens the other side's goalie.  ``collision`` marks games whose
    two colours share a colour word; ``warnings`` counts colours without one.
    """
    need = ["target_team", "opponent_team", "target_color", "opponent_color"]
    ok = games.filter(" and ".join(f"{c} is not null and {c} <> ''" for c in need))
    tt, ot = color_tokens(F.col("target_color")), color_tokens(F.col("opponent_color"))
    warn = (F.size(tt) == 0).cast("int") + (F.size(ot) == 0).cast("int")
    pair = F.array(
        F.struct(F.lit(0).alias("pos"), F.col("target_team").alias("team"), F.col("opponent_color").alias("threatened_color"), F.lit(False).alias("is_opponent")),
        F.struct(F.lit(1).alias("pos"), F.col("opponent_team").alias("team"), F.col("target_color").alias("threatened_color"), F.lit(True).alias("is_opponent")),
    )
    return ok.select("vid", F.arrays_overlap(tt, ot).alias("collision"), warn.alias("warnings"), F.explode(pair).alias("m")).select(
        "vid", "m.pos", "m.team", "m.threatened_color", "m.is_opponent", "collision", "warnings"
    )


def _teams_of(tmap: DataFrame) -> DataFrame:
    """One row per game with its (at most two) teams in order."""
    return tmap.groupBy("vid").agg(
        F.array_sort(F.collect_list(F.struct("pos", "team", "threatened_color", "is_opponent"))).alias("__teams"),
        F.bool_or("collision").alias("__collision"),
    )


def target_team(win: DataFrame, tmap: DataFrame, color: str = "color") -> DataFrame:
    """The one team threatening a window's colour; null when none or several.

    Colours are compared once per distinct ``(recording, colour)``.
    """
    x = win.filter(F.col(color).isNotNull()).select("vid", color).distinct().join(_teams_of(tmap), "vid")
    hits = F.filter("__teams", lambda m: colors_match(m["threatened_color"], F.col(color)))
    found = x.select("vid", color, F.when(F.size(hits) == 1, F.get(hits, F.lit(0))["team"]).alias("target_team"))
    return win.join(found, ["vid", color], "left")


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != ""))


def expected_color(team: Column, teams: Column) -> Column:
    """Exact name, name ignoring case, else the best share of words (half+)."""
    exact = F.filter(teams, lambda m: m["team"] == team)
    loose = F.filter(teams, lambda m: F.lower(F.trim(m["team"])) == F.lower(F.trim(team)))
    mine = _tokens(team)

    def score(m):
        theirs = _tokens(m["team"])
        n = F.size(F.array_intersect(mine, theirs))
        return F.when(n >= 0.5 * F.greatest(F.size(mine), F.size(theirs)), n).otherwise(F.lit(0))

    ranked = F.array_sort(
        F.filter(
            F.transform(teams, lambda m: F.struct((-score(m)).alias("s"), m["pos"].alias("pos"), m["threatened_color"].alias("color"))),
            lambda r: r["s"] < 0,
        )
    )
    return F.coalesce(
        F.get(exact, F.lit(0))["threatened_color"],
        F.get(loose, F.lit(0))["threatened_color"],
        F.get(ranked, F.lit(0))["color"],
    )


def team_color(ev: DataFrame, tmap: DataFrame, team: str = "team", out: str = "expected_color") -> DataFrame:
    """Colour each event's team threatens, resolved once per distinct team."""
    x = ev.filter(F.col(team).isNotNull()).select("vid", team).distinct().join(_teams_of(tmap), "vid")
    found = x.select("vid", team, expected_color(F.col(team), F.col("__teams")).alias(out), F.col("__collision").alias("collision"))
    return ev.join(found, ["vid", team], "left")


def restrict_gt(gt: DataFrame, games: DataFrame, meta: DataFrame) -> DataFrame:
    """Keep only the opponent's events where the prediction was target-filtered.

    ``meta`` has ``(vid, applied)``; without a game row nothing is dropped.
    """
    opp = games.select("vid", F.col("opponent_team").alias("__opp"))
    x = gt.join(meta.select("vid", "applied"), "vid", "left").join(opp, "vid", "left")
    keep = ~F.coalesce("applied", F.lit(False)) | F.col("__opp").isNull() | teams_match(F.col("team"), F.col("__opp"))
    return x.filter(keep).drop("applied", "__opp")


def crosswalk(df: DataFrame, ids: DataFrame, key: str = "vid", out: str = "gt_id") -> DataFrame:
    """Map ids through ``ids(key, out)``; numeric ids map to themselves."""
    m = ids.select(key, F.col(out).alias("__to"))
    x = df.join(m, key, "left").withColumn(out, F.coalesce("__to", F.col(key).try_cast("bigint"))).drop("__to")
    return x.filter(F.col(out).isNotNull())


def merge_maps(key: str, *sources: DataFrame) -> DataFrame:
    """Union of lookup tables: the later source wins, overlaps are counted."""
    tagged = [s.withColumn("__src", F.lit(i)) for i, s in enumerate(sources)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    cols = [c for c in sources[0].columns if c != key]
    return both.groupBy(key).agg(
        *[F.max_by(c, "__src").alias(c) for c in cols], (F.count_distinct("__src") > 1).alias("overlapping")
    )


def team_roles(ev: DataFrame, actions=("Shots", "Goals")) -> DataFrame:
    """Target and opponent: the two busiest teams, first seen first on ties."""
    per_team = ev.filter(F.col("action").isin(*actions)).groupBy("vid", "team").agg(
        F.count("*").alias("n"), F.min("idx").alias("first")
    )
    w = W.partitionBy("vid").orderBy(F.desc("n"), F.asc("first"))
    top = per_team.withColumn("r", F.row_number().over(w)).filter("r <= 2")
    return (
        top.groupBy("vid")
        .agg(F.max(F.when(F.col("r") == 1, F.col("team"))).alias("target_team"), F.max(F.when(F.col("r") == 2, F.col("team"))).alias("opponent_team"))
        .filter("opponent_team is not null")
    )


def shot_rows(ev: DataFrame, actions=("Shots", "Goals", "OZ play")) -> DataFrame:
    """Threat rows per recording, as counted when splitting data."""
    return ev.groupBy("vid").agg(F.count_if(F.col("action").isin(*actions)).alias("n_threats"))
