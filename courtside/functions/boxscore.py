"""Per-row box-score statistics (P20-P37): Column expressions, null or zero where a denominator is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the share of free-throw attempts that ends a possession.
FREE_THROW_SHARE = 0.44


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as a double; null if ``b`` is null or zero."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def possessions(fga: Column, fta: Column, tov: Column | None = None) -> Column:
    used = fga + F.lit(FREE_THROW_SHARE) * fta
    return used if tov is None else used + tov


def is_legacy(*modern: Column) -> Column:
    """P20: a player row is in the older vocabulary if it has none of the modern keys."""
    return F.coalesce(*modern).isNull()


def made_attempted(two_made: Column, two_tried: Column, three_made: Column, three_tried: Column) -> tuple[Column, Column]:
    """Field goals of a modern row, the sum of two- and three-point shots."""
    zero = F.lit(0)
    return F.coalesce(two_made, zero) + F.coalesce(three_made, zero), F.coalesce(two_tried, zero) + F.coalesce(three_tried, zero)


def percentage(made: Column, tried: Column) -> Column:
    """0-100; no attempts give 0."""
    return F.coalesce(ratio(made, tried) * 100, F.lit(0.0))


def true_shooting(points: Column, fga: Column, fta: Column) -> Column:
    """P25."""
    return ratio(points, 2 * possessions(fga, fta))


def effective_field_goals(fgm: Column, fg3m: Column, fga: Column) -> Column:
    """P26."""
    return ratio(fgm + 0.5 * fg3m, fga)


def turnover_rate(tov: Column, fga: Column, fta: Column) -> Column:
    """P27."""
    return ratio(tov, possessions(fga, fta, tov))


def free_throw_rate(fta: Column, fga: Column) -> Column:
    """P28."""
    return ratio(fta, fga)


def assist_turnover(ast: Column, tov: Column) -> Column:
    """Assists a turnover; without turnovers the assists themselves, null if there are none either."""
    return F.when(tov == 0, F.nullif(ast, F.lit(0)).cast("double")).otherwise(ratio(ast, tov))


def offensive_rating(points: Column, fga: Column, fta: Column, tov: Column) -> Column:
    """Points a hundred possessions."""
    return ratio(100 * points, possessions(fga, fta, tov))


def efficiency_rating(points, reb, ast, stl, blk, fgm, fga, ftm, fta, tov, minutes) -> Column:
    """Simplified player efficiency."""
    return ratio(15 * (points + reb + ast + stl + blk - (fga - fgm) - (fta - ftm) - tov), minutes)


def usage(fga: Column, fta: Column, tov: Column, minutes: Column) -> Column:
    """Possessions a minute, times 100."""
    return ratio(100 * possessions(fga, fta, tov), minutes)


def usage_of_team(fga, fta, tov, minutes, team_possessions, team_minutes) -> Column:
    """The share of the team's possessions while on court."""
    return ratio(100 * possessions(fga, fta, tov) * team_minutes / 5, minutes * team_possessions)


def rebound_rate(own: Column, team: Column, opponent: Column, minutes: Column | None = None, team_minutes: Column | None = None) -> Column:
    """Rebounds over those on offer, adjusted for minutes if they are given."""
    rate = ratio(own, team + opponent)
    return rate if minutes is None else rate * ratio(team_minutes, 5 * minutes)


def win_shares(per: Column, minutes: Column) -> Column:
    """P35."""
    return per * minutes / 4000


def per_36(value: Column, minutes: Column) -> Column:
    """A total scaled to 36 minutes."""
    return ratio(value * 36, minutes)


def advanced() -> dict[str, Column]:
    """Every advanced statistic of a row with the columns of the box score."""
    c = F.col
    per = efficiency_rating(c("points"), c("reb"), c("ast"), c("stl"), c("blk"), c("fgm"), c("fga"), c("ftm"), c("fta"), c("tov"), c("minutes"))
    return {
        "true_shooting": true_shooting(c("points"), c("fga"), c("fta")),
        "effective_fg": effective_field_goals(c("fgm"), c("fg3m"), c("fga")),
        "turnover_rate": turnover_rate(c("tov"), c("fga"), c("fta")),
        "free_throw_rate": free_throw_rate(c("fta"), c("fga")),
        "assist_turnover": assist_turnover(c("ast"), c("tov")),
        "offensive_rating": offensive_rating(c("points"), c("fga"), c("fta"), c("tov")),
        "efficiency_rating": per,
        "usage": usage(c("fga"), c("fta"), c("tov"), c("minutes")),
        "win_shares": win_shares(per, c("minutes")),
        "win_shares_36": per_36(win_shares(per, c("minutes")), c("minutes")),
        "points_36": per_36(c("points"), c("minutes")),
        "field_goal_pct": percentage(c("fgm"), c("fga")),
        "free_throw_pct": percentage(c("ftm"), c("fta")),
    }
