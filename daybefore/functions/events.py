"""Located-event columns: geometry, manpower, shot type, danger zone, attribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the event model.
GOAL_LINE = 89.0
SHOT_KINDS = ["wrist", "slap", "snap", "backhand", "tip-in", "deflection", "bat", "between-legs",
              "poke", "wrap-around"]
ATTEMPTS = ["goal", "shot-on-goal", "missed-shot", "blocked-shot"]
ON_TARGET = ["shot-on-goal", "goal"]
BLOCKED = "blocked-shot"
DEFAULT_SITUATION = "1551"
SLOT_DEPTH = 20.0
SLOT_HALF_WIDTH = 22.0
LAST_PERIOD = 4


def shot_kind_code(col: Column | str) -> Column:
    c = F.lower(F.col(col) if isinstance(col, str) else col)
    pos = F.array_position(F.array(*[F.lit(k) for k in SHOT_KINDS]), F.coalesce(c, F.lit("")))
    return F.when(pos > 0, pos - 1).otherwise(F.lit(len(SHOT_KINDS))).cast("int")


def distance(x: Column, y: Column) -> Column:
    x, y = F.coalesce(x.cast("double"), F.lit(0.0)), F.coalesce(y.cast("double"), F.lit(0.0))
    dx = F.when(x >= 0, F.lit(GOAL_LINE)).otherwise(F.lit(-GOAL_LINE)) - x
    return F.sqrt(dx * dx + y * y)


def angle(x: Column, y: Column) -> Column:
    x, y = F.coalesce(x.cast("double"), F.lit(0.0)), F.coalesce(y.cast("double"), F.lit(0.0))
    dx = F.when(x >= 0, F.lit(GOAL_LINE)).otherwise(F.lit(-GOAL_LINE)) - x
    return F.degrees(F.atan2(F.abs(y), F.greatest(F.abs(dx), F.lit(0.01))))


def behind_net(x: Column) -> Column:
    return (F.abs(F.coalesce(x.cast("double"), F.lit(0.0))) > GOAL_LINE).cast("int")


def manpower(code: Column, owner: Column, home: Column) -> dict[str, Column]:
    """Empty-net, power-play and short-handed flags from the shooter's side.

    The four digits are away goalie, away skaters, home skaters, home goalie.  A digit
    that does not parse counts as 1 for a goalie and 5 for skaters.
    """
    code = F.coalesce(code, F.lit(DEFAULT_SITUATION))

    def digit(i: int, default: int) -> Column:
        return F.coalesce(F.substring(code, i, 1).try_cast("int"), F.lit(default))

    is_home = F.coalesce(owner == home, F.lit(False))
    shooters = F.when(is_home, digit(3, 5)).otherwise(digit(2, 5))
    others = F.when(is_home, digit(2, 5)).otherwise(digit(3, 5))
    keeper = F.when(is_home, digit(1, 1)).otherwise(digit(4, 1))
    return {
        "is_pp": ((shooters > others) & (keeper == 1)).cast("int"),
        "is_sh": ((shooters < others) & (keeper == 1)).cast("int"),
        "is_en": (keeper == 0).cast("int"),
    }


def period_capped(col: Column) -> Column:
    return F.least(F.coalesce(col.cast("int"), F.lit(1)), F.lit(LAST_PERIOD))


def high_danger(x: Column, y: Column) -> Column:
    front = F.lit(GOAL_LINE) - F.abs(F.coalesce(x.try_cast("double"), F.lit(0.0)))
    wide = F.abs(F.coalesce(y.try_cast("double"), F.lit(0.0)))
    return (front.between(0.0, SLOT_DEPTH) & (wide <= SLOT_HALF_WIDTH)).cast("int")


def attacker(kind: Column, owner: Column, home: Column, away: Column, owner_blocks: bool = True) -> Column:
    """The attacking side; on a blocked attempt the recorded owner is the blocker."""
    if not owner_blocks:
        return owner
    flipped = F.when(owner == home, away).otherwise(home)
    return F.when(kind == BLOCKED, flipped).otherwise(owner)
