"""A plain per-row reading of time texts, written apart from the engine, to test it against."""

import calendar
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

MON = {m.lower(): i for i, m in enumerate(calendar.month_name) if m} | {m.lower(): i for i, m in enumerate(calendar.month_abbr) if m}
LOW, HIGH = 1704067200000, 1735689600000


def to_ms(text, tz, order, abbreviations):
    if text is None:
        return None
    s = text.strip()
    if re.fullmatch(r"\d+([.,]\d+)?", s) and not re.fullmatch(r"\d{8}|\d{14}", s):
        whole, _, frac = s.replace(",", ".").partition(".")
        for ns in (86400 * 10**9, 3600 * 10**9, 60 * 10**9, 10**9, 10**6, 10**3, 1):
            total = int(whole) * ns + (int((frac + "0" * 9)[:9]) * ns // 10**9 if frac else 0)
            if LOW <= total // 10**6 < HIGH:
                return total // 10**6
    zone = None
    clock = s
    m = re.search(r"(?:(?<=\d)Z| ?(UTC|GMT)?([+-])(\d\d):?(\d\d)| ([A-Za-z_]+/[A-Za-z_]+|[A-Z]{3,4}))$", s)
    if m and not re.search(r"\d\d[-/]\d\d[-/]\d{4}$", s) and (":" in s or "T" in s):
        clock = s[: m.start()]
        if m[2]:
            zone = timedelta(minutes=(1 if m[2] == "+" else -1) * (int(m[3]) * 60 + int(m[4])))
        elif m[5]:
            if m[5] in abbreviations:
                zone = timedelta(minutes=abbreviations[m[5]])
            else:
                try:
                    zone = ZoneInfo(m[5])
                except Exception:
                    return None
        else:
            zone = timedelta(0)
    clock = re.sub(r"^[A-Z][a-z]+, ", "", clock.strip())
    half = None
    if m := re.search(r" ([AP])M$", clock):
        half, clock = m[1], clock[: m.start()]
    for rx, names in (
        (r"(\d{4})[-/](\d\d)[-/](\d\d)", "Ymd"), (r"(\d\d)/(\d\d)/(\d{4})", "abY"), (r"(\d\d?)[- ]([A-Za-z]+)[- ](\d{4})", "dmY"),
        (r"([A-Za-z]+) (\d\d?), (\d{4})", "mdY"), (r"(\d{4})(\d\d)(\d\d)", "Ymd"),
    ):
        if m := re.match(rx, clock):
            rest, v = clock[m.end() :], dict(zip(names, m.groups(), strict=True))
            break
    else:
        return None
    if "a" in v:
        if order not in ("dmy", "mdy"):
            return None
        v["d"], v["m"] = (v["a"], v["b"]) if order == "dmy" else (v["b"], v["a"])
    rest = rest.lstrip("T ,")
    m = re.fullmatch(r"(?:(\d\d?):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?|(\d\d)(\d\d)(\d\d)?)?", rest)
    if not m:
        return None
    h, mi, se = int(m[1] or m[5] or 0), int(m[2] or m[6] or 0), int(m[3] or m[7] or 0)
    if half:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (half == "P")
    try:
        wall = datetime(int(v["Y"]), MON[v["m"].lower()] if v["m"].isalpha() else int(v["m"]), int(v["d"]), h, mi, se)
    except (ValueError, KeyError):
        return None
    if zone is None:
        if tz is None:
            return None
        zone = ZoneInfo(tz)
    if isinstance(zone, timedelta):
        at = wall.replace(tzinfo=timezone.utc) - zone
    else:
        # fold=0: the first of two occurrences; in a gap, the offset before it
        at = wall.replace(tzinfo=timezone.utc) - wall.replace(tzinfo=zone, fold=0).utcoffset()
    ms = int((at - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(milliseconds=1)) + int(((m[4] or "") + "000")[:3])
    # the first midnight of the year lies before it in UTC where clocks are ahead
    return ms if LOW <= ms < HIGH or wall.year == 2024 else None
