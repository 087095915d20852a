"""Names, fixed values and limits shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Columns of the raw log, and the columns that identify one event.
ID, EVENT, TIME, PARAM = "idfa", "event", "time", "param"
LOG_COLUMNS = (ID, EVENT, TIME, PARAM)
DEDUP_KEYS = (ID, EVENT, TIME)

# Device ids that mean "no id".
INVALID_IDS = (
    "00000000-0000-0000-0000-000000000000",
    "unknown-adid",
    "0000-0000",
    "unknow-adid",
)

# A group with more rows than this is never handled by one task; see
# operators/sequence.py and operators/quantiles.py for what happens instead.
MAX_GROUP_ROWS = 2_000_000

# Hot keys are broadcast only up to this many; there are at most
# total_rows / MAX_GROUP_ROWS of them.
MAX_BROADCAST_KEYS = 500_000

# Session break, in seconds.
SESSION_GAP_S = 30 * 60

# Days without activity after which a user counts as churned.
CHURN_DAYS = 7


@dataclass(frozen=True)
class Roles:
    """What the event names and parameters of one particular log stand for.

    The first five fields are event names. The last three are SQL expressions
    over the typed event view (see ``sources.event_log``).
    """

    round_start: str = "round_start"
    round_end: str = "round_end"
    ad_show: str = "ad_show"
    ad_done: str = "ad_done"
    button: str = "button"
    win: str = "params['win'] = '1'"
    scene: str = "params['scene']"
    button_id: str = "params['button']"
