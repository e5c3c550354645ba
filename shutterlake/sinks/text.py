"""Short text forms of values, and the summary that a scan prints."""

from __future__ import annotations

from datetime import datetime


def count(x) -> str:
    if x is None:
        return "-"
    return f"{x:.1f}" if isinstance(x, float) and not x.is_integer() else f"{int(x):,}"


def some(n, one: str, many: str | None = None) -> str:
    """A number with its noun."""
    return f"{count(n)} {one if n is not None and abs(n) == 1 else many or one + 's'}"


def percent(x) -> str:
    return "-" if x is None else "<1%" if 0 < x < 0.01 else f"{x * 100:.0f}%"


def short(x) -> str:
    return "-" if x is None else f"{x:.1f}".rstrip("0").rstrip(".") or "0"


def day(text: str | None) -> str:
    if not text:
        return "-"
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        return text
    return f"{at.day} {at:%b %Y}"


def size(n: float) -> str:
    for unit in ("B", "KB", "MB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} GB"


def summary(report: dict) -> str:
    """At most eleven lines on a report."""
    scan, span, places = report["scan"], report["span"], report["locations"]
    lines = [("frames read", count(scan["photos"]))]
    if span["first"]:
        lines += [("date span", f"{day(span['first'])} to {day(span['last'])}"), ("days shot", count(span["active_days"]))]
    if bodies := report["gear"]["cameras"]:
        lines += [("bodies", count(len(bodies))), ("most used", f"{bodies[0]['name']} ({some(bodies[0]['count'], 'frame')})")]
    if report["focal"]["available"]:
        lines.append(("median focal", f"{short(report['focal']['median'])}mm"))
    if wide := report["aperture"].get("wide_open"):
        lines.append(("wide open", f"{percent(wide['share'])} of frames"))
    if report["iso"]["available"]:
        lines.append(("iso ceiling", f"{count(report['iso']['ceiling'])} (99th percentile)"))
    if places["clusters"]:
        lines.append(("places", f"{some(places['total_clusters'], 'cluster')}, {some(places['photos'], 'frame')} tagged"))
    if scan["unsupported"]:
        lines.append(("not parsed", f"{some(scan['unsupported'], 'file')} ({', '.join(scan['unsupported_formats'])})"))
    if scan["no_exif"]:
        lines.append(("no exif", some(scan["no_exif"], "file")))
    return "\n".join(f"  {k:<16} {v}" for k, v in lines)
