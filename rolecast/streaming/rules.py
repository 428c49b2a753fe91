"""Board timing for single values, where a stream keeps its state in Python."""

from datetime import datetime, timedelta

HOURS = {"active": 12, "empty": 96, "invalid": 720}


def next_time(status: str, failures: int, now: str) -> str:
    """When a board is due again, as an ISO text."""
    wait = timedelta(hours=HOURS[status]) if status in HOURS else timedelta(minutes=min(1440, 15 * 2 ** max(0, failures)))
    at = datetime.fromisoformat(now.replace("Z", "+00:00")) + wait
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"
