"""The report as one self-contained HTML page: no script, no outside resource, ASCII only."""

from __future__ import annotations

import html
from collections.abc import Iterable
from datetime import date, timedelta

from .text import count, day, percent, short, size, some

STYLE = """
:root{--ink:#1d2329;--soft:#66707a;--line:#d9dee3;--bar:#2f6f8f;--hot:#b4472f;--paper:#fff}
@media(prefers-color-scheme:dark){:root{--ink:#e6e9ec;--soft:#9aa4ad;--line:#39424a;--bar:#5fa8cc;--hot:#e07a5f;--paper:#14181c}}
body{font:16px/1.5 system-ui,sans-serif;color:var(--ink);background:var(--paper);max-width:820px;margin:0 auto;padding:1rem}
h1{margin-bottom:0}h2{margin-top:2.5rem;border-top:1px solid var(--line);padding-top:1rem}table{border-collapse:collapse;width:100%}
td,th{text-align:left;padding:.25rem .5rem;border-bottom:1px solid var(--line)}td.n{text-align:right;font-variant-numeric:tabular-nums}
.note{color:var(--soft)}.wide{overflow-x:auto}svg text{fill:var(--soft);font-size:10px}svg .b{fill:var(--bar)}svg .hot{fill:var(--hot)}
.tag{display:inline-block;border:1px solid var(--line);border-radius:4px;padding:0 .4rem;margin:.15rem}.tag.none{border-color:var(--hot);color:var(--hot)}
.d0{fill:var(--line)}.d1{fill:var(--bar);opacity:.35}.d2{fill:var(--bar);opacity:.55}.d3{fill:var(--bar);opacity:.78}.d4{fill:var(--bar)}
"""
#: Rows that the page shows of long tables.
CAMERAS, LENSES, TIMELINE, ZOOMS, PLACES, UNREACHED = 20, 24, 12, 6, 25, 8


def esc(x) -> str:
    """Escaped, and with everything beyond ASCII as a reference."""
    return html.escape("" if x is None else str(x)).encode("ascii", "xmlcharrefreplace").decode()


def table(heads: list[str], rows: Iterable[Iterable]) -> str:
    body = "".join("<tr>" + "".join(f'<td class="n">{esc(c[0])}</td>' if isinstance(c, tuple) else f"<td>{esc(c)}</td>" for c in r) + "</tr>" for r in rows)
    return f'<div class="wide"><table><tr>{"".join(f"<th>{esc(h)}</th>" for h in heads)}</tr>{body}</table></div>'


def steps(most: int) -> list[int]:
    """Round axis marks from 0 to at least ``most``, five or so."""
    if most <= 0:
        return [0]
    unit = 10 ** (len(str(most)) - 1)
    step = next(int(max(1, unit * f)) for f in (0.25, 0.5, 1, 2, 2.5, 5, 10) if most <= 4 * unit * f)
    return list(range(0, most + step, step))


def bars(rows: list[dict], label: str, hot: set | frozenset = frozenset(), high: int = 180, wide: int = 760) -> str:
    """A bar for each row's count; labels are thinned to fit."""
    if not rows:
        return ""
    most = max(r["count"] for r in rows)
    marks = steps(most)
    top, each = max(marks[-1], 1), (wide - 50) / len(rows)
    every = max(1, -(-len(rows) * 34 // (wide - 50)))
    out = [f'<svg viewBox="0 0 {wide} {high + 40}" role="img" aria-label="counts by {esc(label)}">']
    for m in marks:
        y = 10 + high * (1 - m / top)
        out.append(f'<text x="0" y="{y + 3:.1f}">{m:,}</text><line x1="44" x2="{wide}" y1="{y:.1f}" y2="{y:.1f}" stroke="currentColor" opacity=".12"/>')
    for i, r in enumerate(rows):
        h, x = high * r["count"] / top, 46 + i * each
        name = esc(r[label])
        out.append(f'<rect class="{"hot" if r[label] in hot else "b"}" x="{x:.1f}" y="{10 + high - h:.1f}" width="{max(each - 2, 1):.1f}" height="{h:.1f}"><title>{name}: {r["count"]:,}</title></rect>')
        if i % every == 0:
            out.append(f'<text x="{x + each / 2:.1f}" y="{high + 26}" text-anchor="middle">{name}</text>')
    return f'<div class="wide">{"".join(out)}</svg></div>'


def spread(zoom: dict, wide: int = 760) -> str:
    """Where on a zoom's range its frames lie."""
    parts, x = [], 0.0
    for key, name in (("wide_end", "wide end"), ("middle", "between"), ("long_end", "long end")):
        w = zoom[key] * wide
        parts.append(f'<rect class="{"hot" if key == "middle" else "b"}" x="{x:.1f}" y="2" width="{max(w - 1, 0):.1f}" height="16"><title>{name}: {percent(zoom[key])}</title></rect>')
        x += w
    return f'<svg viewBox="0 0 {wide} 20" role="img" aria-label="use of the range">{"".join(parts)}</svg>'


def heatmap(years: list[dict]) -> str:
    """A row of weeks for each year; a day's shade is relative to its year's busiest."""
    out = [f'<svg viewBox="0 0 760 {len(years) * 112}" role="img" aria-label="days by year">']
    for k, y in enumerate(years):
        base, first = k * 112, date(y["year"], 1, 1)
        out.append(f'<text x="0" y="{base + 12}">{y["year"]}: {some(y["total"], "frame")} on {some(y["active_days"], "day")}</text>')
        at = first
        while at.year == y["year"]:
            n = y["days"].get(at.isoformat(), 0)
            level = 0 if not n else min(4, 1 + int(4 * n / max(y["max"], 1)))
            week = ((at - first).days + first.weekday()) // 7
            out.append(f'<rect class="d{level}" x="{week * 14}" y="{base + 18 + at.weekday() * 13}" width="12" height="11"><title>{at.isoformat()}: {n:,}</title></rect>')
            at += timedelta(1)
            if at.year > 9998:
                break
    return f'<div class="wide">{"".join(out)}</svg></div>'


def tags(items: Iterable[tuple[str, bool]]) -> str:
    return "".join(f'<span class="tag{" none" if none else ""}">{esc(t)}</span>' for t, none in items)


def section(name: str, title: str, *parts: str) -> str:
    return f'<section id="{name}"><h2>{esc(title)}</h2>{"".join(parts)}</section>'


def note(text: str) -> str:
    return f'<p class="note">{esc(text)}</p>'


def masthead(r: dict) -> str:
    scan, span = r["scan"], r["span"]
    head = f"<h1>{esc('How this library was shot')}</h1>"
    when = f", {day(span['first'])} to {day(span['last'])}, on {some(span['active_days'], 'day')}" if span["first"] else ""
    kept = [f"{k}: {v}" for k, v in r["filters"].items() if v and k != "gps"]
    return head + note(f"{some(scan['photos'], 'frame')}{when}." + (f" Only {'; '.join(kept)}." if kept else ""))


def gear(r: dict) -> str:
    g = r["gear"]
    use = lambda x: [x["name"], (count(x["count"]),), (percent(x["share"]),), (count(x["days"]),), day(x["first"]), day(x["last"])]
    heads = ["", "frames", "share", "days", "first", "last"]
    ends = lambda x: f"{short(x['focal_low'])}-{short(x['focal_high'])}mm" if x["focal_low"] is not None else "-"
    lenses = [[*use(x), ends(x), f"f/{short(x['widest_aperture'])}" if x["widest_aperture"] else "-"] for x in g["lenses"][:LENSES]]
    told = [x for x in r["habits"] if x["kind"] == "gear"]
    return section("gear", "Bodies and lenses", table(heads, map(use, g["cameras"][:CAMERAS])), table([*heads, "used", "widest"], lenses), table(["body", "lens", "frames"], [[p["camera"], p["lens"], (count(p["count"]),)] for p in g["pairs"][:TIMELINE]]), *(note(f"{x['title']}. {x['detail']}") for x in told))


def focal(r: dict) -> str:
    f = r["focal"]
    if not f["available"]:
        return section("focal", "Focal lengths", note("No frame has a focal length."))
    band = f["band"]
    said = f"Half of the frames ({percent(band['share'])}) lie between {short(band['low'])} and {short(band['high'])}mm; the median is {short(f['median'])}mm."
    zooms = "".join(f"<h3>{esc(z['lens'])}</h3>" + note(f"{z['verdict']}, of {short(z['low'])}-{short(z['high'])}mm ({z['basis']}), {some(z['count'], 'frame')}") + spread(z) for z in f["zooms"][:ZOOMS])
    return section("focal", "Focal lengths", note(said), bars(f["histogram"], "label"), zooms)


def exposure(r: dict) -> str:
    parts, a, s = [], r["aperture"], r["shutter"]
    if a["available"]:
        wide = a["wide_open"]
        parts += [bars(a["histogram"], "label"), note(f"Median f/{short(a['median'])}." + (f" Wide open in {percent(wide['share'])} of frames." if wide else ""))]
    if s["available"]:
        rule = s["reciprocal"]
        parts += [bars(s["histogram"], "label"), note(f"{s['fastest']} to {s['slowest']}, median {s['median']}." + (f" {percent(rule['share'])} were longer than the focal length allows by the rule of thumb." if rule else ""))]
    return section("exposure", "Aperture and shutter", *(parts or [note("No frame has either.")]))


def iso(r: dict) -> str:
    i = r["iso"]
    if not i["available"]:
        return section("iso", "Sensitivity", note("No frame has a sensitivity."))
    return section("iso", "Sensitivity", bars(i["histogram"], "label"), note(f"Base {count(i['base'])}, median {count(i['median'])}; 99% of frames are at {count(i['ceiling'])} or below."))


MISSING = {"omitted": "Twilight is left out with positions.", "no-coordinate": "No position, so no twilight.", "undefined": "The sun does not set or rise there in any month."}


def time(r: dict) -> str:
    t = r["time_of_day"]
    w = t["twilight"]
    clock = lambda x: f"{int(x) % 24:02d}:{int(x * 60) % 60:02d}"
    said = MISSING[t["twilight_missing"]] if not w else f"Civil dawn {clock(w['dawn_earliest'])} to {clock(w['dawn_latest'])}, dusk {clock(w['dusk_earliest'])} to {clock(w['dusk_latest'])} ({w['basis']}); {percent(w['golden_share'])} of frames in hours that begin in the hour and a half from dawn or around dusk."
    return section("time", "Time of day", bars([{**h, "hour": f"{h['hour']:02d}"} for h in t["hours"]], "hour"), note(said), bars(t["weekdays"], "day", high=90), bars(t["months"], "month", high=90))


def calendar(r: dict) -> str:
    c = r["calendar"]
    if not c["years"]:
        return section("calendar", "Calendar", note("No frame has a date."))
    b = c["busiest_day"]
    return section("calendar", "Calendar", note(f"{some(c['days_shot'], 'day')}; most on {day(b['date'])} ({some(b['count'], 'frame')}); median {count(c['median_frames_per_active_day'])} a day."), heatmap(c["years"]))


def places(r: dict) -> str:
    p = r["locations"]
    rows = [[x["label"], (count(x["count"]),), (percent(x["share"]),), (count(x["days"]),), (f"{x['radius_km']} km",)] for x in p["clusters"][:PLACES]]
    return section("places", "Places", note(p["note"]), table(["", "frames", "share", "days", "radius"], rows) if rows else "")


def absences(r: dict) -> str:
    a = r["absences"]
    if not a["enough_data"]:
        parts = [note("Too few frames to say which settings are not used.")]
    else:
        named = lambda rows, form: tags((form.format(short(x["value"])) + (f" ({x['count']})" if x["count"] else ""), not x["count"]) for x in rows)
        parts = ["<h3>Focal lengths</h3>", named(a["focal_lengths"], "{}mm") or note("None in the used range."), "<h3>Apertures</h3>", named(a["apertures"], "f/{}") or note("None in the used range.")]
    if a["hours"]:
        parts += ["<h3>Hours</h3>", tags((f"{h['start']:02d}:00-{h['end']:02d}:59", True) for h in a["hours"])]
    if a["weekdays"]:
        parts += ["<h3>Weekdays</h3>", tags((d, True) for d in a["weekdays"])]
    parts += [note(f"{x['lens']} goes to {short(x['declared'])}mm and was used to {short(x['reached'])}mm.") for x in a["unreached_focal_range"][:UNREACHED]]
    return section("absences", "What is not used", *parts)


def habits(r: dict) -> str:
    return section("habits", "Habits", *(f"<h3>{esc(h['title'])}</h3>{note(h['detail'])}" for h in r["habits"] if h["kind"] != "gear")) if r["habits"] else ""


def footer(r: dict) -> str:
    s = r["scan"]
    each = s["bytes_read"] / s["files_seen"] if s["files_seen"] else 0
    left = [f"{some(s[k], 'file')} {name}" for k, name in (("no_exif", "without EXIF"), ("unsupported", "of formats not read"), ("unreadable", "not readable"), ("filtered_out", "filtered out")) if s[k]]
    return f"<footer>{note(f'{some(s["files_seen"], "file")} seen, {size(s["bytes_read"])} of headers read ({size(each)} a file). ' + ', '.join(left))}</footer>"


def render(report: dict) -> str:
    parts = (masthead, gear, focal, exposure, iso, time, calendar, places, absences, habits, footer)
    return f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width"><title>How this library was shot</title><style>{STYLE}</style></head><body>{"".join(p(report) for p in parts)}</body></html>\n'
