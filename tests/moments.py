"""Times written as text."""

import datetime as dt


def moment(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)
