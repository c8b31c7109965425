"""One round of a polled feed: sources by themselves, retries, and how bad a round was."""

import time

from cindergrid.functions.feed import combined, normalised

HIDDEN = "***"


class Rejected(Exception):
    """An answer that asking again won't change. status: that of the answer, if it had one."""

    def __init__(self, message, status=None):
        super().__init__(message)
        self.status = status


def permanent(error):
    """Whether an error is the asker's own, with a status of 400 to 499, so that no later round can do better."""
    status = getattr(error, "status", None)
    return isinstance(status, int) and 400 <= status < 500


def shown(error, secret=None):
    """The first line of an error's text, at most 200 characters, without the secret."""
    text = str(error) or type(error).__name__
    text = text.replace(secret, HIDDEN) if secret else text
    return (text.splitlines() or [type(error).__name__])[0][:200]


def fetched(read, tries=3, wait=4.0, sleep=time.sleep, secret=None):
    """(rows, status) of a source: read() again after wait, 2 * wait ... seconds, unless it was rejected. Never an error."""
    for n in range(1, tries + 1):
        try:
            rows = read()
            return rows, {"ok": True, "rows": rows.count(), "error": None, "permanent": False}
        except Exception as e:  # a source's failure is its own
            if n == tries or permanent(e) or isinstance(e, Rejected) and e.status is None:
                return None, {"ok": False, "rows": 0, "error": shown(e, secret), "permanent": permanent(e)}
            sleep(wait * n)


def poll(spark, sources, **how):
    """(detections or None, status table) of all sources; one that fails leaves the others alone. sources: name -> function without arguments. how: as of fetched; secret: never shown in the status."""
    feeds, status = [], []
    for name, read in sources.items():
        rows, s = fetched(read, **how)
        status.append((name, s["ok"], s["rows"], s["error"], s["permanent"]))
        if rows is not None:
            feeds.append(normalised(rows, name))
    table = spark.createDataFrame(status, "source string, ok boolean, rows long, error string, permanent boolean")
    return (combined(feeds) if feeds else None), table


def exit_code(status, age_minutes, has_key=True, tolerated=180):
    """0: some source came, or all failed and what is published is under the tolerated age; 1: all failed and it is older, of unknown age, or an error is permanent; 2: no key."""
    if not has_key:
        return 2
    rows = status.collect()
    if any(r.ok for r in rows):
        return 0
    if any(r.permanent for r in rows):
        return 1
    return 0 if age_minutes is not None and age_minutes < tolerated else 1
