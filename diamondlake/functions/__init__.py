"""Column functions of the engine in one place: text and date rules, report and surface expressions."""

from ..operators.bio import (
    add_years,
    age_on,
    draft_day,
    draft_eligible,
    normal_name,
    parse_birth_date,
    parse_date_input,
    parse_height,
    parse_height_input,
    search_name,
)
from ..operators.fold import file_date, postseason_start
from ..operators.reports import count_split, effective_type, family, hand_split, in_zone, located, mean_direction, share, spin_clock, tally, typical
from ..operators.runs import outs_made, state_text
from ..operators.scouting import date_stamp, grades_line, player_key, thread_token
from ..operators.serving import barrel, level_is, year_in
from ..operators.surfaces import cell, out_of_zone
from ..sources.ingest import number

__all__ = [
    "add_years", "age_on", "barrel", "cell", "count_split", "date_stamp", "draft_day", "draft_eligible", "effective_type", "family", "file_date", "grades_line",
    "hand_split", "in_zone", "level_is", "located", "mean_direction", "normal_name", "number", "out_of_zone", "outs_made", "parse_birth_date", "parse_date_input",
    "parse_height", "parse_height_input", "player_key", "postseason_start", "search_name", "share", "spin_clock", "state_text", "tally", "thread_token", "typical", "year_in",
]
