"""The changes of result files by plain loops over chains, to compare the operator with."""

import re
from collections import defaultdict

import pyarrow.parquet as pq

BLANKS = " \t\r\n\ufeff"
INTEGER = re.compile(r"[+-]?[0-9]+\Z")
DECIMAL = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\Z")


def clean(cell):
    cell = cell.strip(BLANKS)
    if len(cell) > 1 and cell[0] == cell[-1] == '"':
        cell = cell[1:-1].replace('""', '"').strip(BLANKS)
    return cell


def split(text, delimiter):
    cells, cell, quoted = [], "", False
    for c in text:
        quoted ^= c == '"'
        if c == delimiter and not quoted:
            cells.append(cell)
            cell = ""
        else:
            cell += c
    return [clean(c) for c in [*cells, cell]]


def kind(values):
    if all(map(INTEGER.match, values)):
        return "bigint"
    if all(map(DECIMAL.match, values)):
        return "double"
    return "boolean" if all(v.lower() in ("true", "false") for v in values) else "string"


def load(file, lines):
    """(names, run -> name -> value, name -> type) of a file."""
    if 0 not in lines:
        return [], {}, {}
    delimiter = file["delimiter"]
    if not delimiter or delimiter not in lines[0]:
        delimiter = max([",", ";", "\t", "|"], key=lines[0].count)
    names, runs = split(lines[0], delimiter), {}
    values = {n: [] for n in names}
    for i in sorted(lines):
        if i == 0 or not (lines[i] or "").strip(BLANKS):
            continue
        cells, row = split(lines[i], delimiter), {}
        for at, n in enumerate(names):
            if n not in row:
                v = cells[at] if at < len(cells) else None
                row[n] = None if v is None or v.lower() in ("", "na", "null", "nan") else v
                values[n] += [] if row[n] is None else [row[n]]
        runs.setdefault(row.get("run_id"), row)
    return names, runs, {n: kind(v) for n, v in values.items()}


def equal(a, b):
    if a is None or b is None:
        return a is b
    return float(a) == float(b) if DECIMAL.match(a) and DECIMAL.match(b) else a == b


def chained(folder):
    """(chains of files in order, file_id -> line_no -> text)."""
    lines = defaultdict(dict)
    for r in pq.read_table(f"{folder}/result_lines.parquet").to_pylist():
        lines[r["file_id"]][r["line_no"]] = r["line_text"]
    first = {}
    for r in sorted(pq.read_table(f"{folder}/result_files.parquet").to_pylist(), key=lambda r: r["file_id"]):
        first.setdefault((r["folder"], r["table_name"], r["seq_no"]), r)
    chains = defaultdict(list)
    for key in sorted(first):
        chains[key[:2]].append(first[key])
    return chains, lines


def renames(old, new):
    """name of the new file -> name of the old one that it goes on from."""
    (old_names, old_runs, old_types), (names, runs, types) = old, new
    gone, shared = [n for n in old_names if n not in types], (set(old_runs) & set(runs)) - {None}
    before = {n: n for n in types if n in old_types}
    for n in names:
        match = [g for g in gone if n not in old_types and shared and all(equal(old_runs[s][g], runs[s][n]) for s in shared)]
        if match:
            gone.remove(match[0])
            before[n] = match[0]
    return before


def descent(folder):
    """(file_id -> table, (file_id, name) -> (file_id, name) with which it began)."""
    chains, lines = chained(folder)
    tables, roots = {}, {}
    for (_, table), chain in chains.items():
        last = None
        for f in chain:
            tables[f["file_id"]] = table
            now = load(f, lines[f["file_id"]])
            before = renames(last[1], now) if last else {}
            for n in now[2]:
                roots[f["file_id"], n] = roots[last[0], before[n]] if n in before else (f["file_id"], n)
            last = (f["file_id"], now)
    return tables, roots


def lines(folder):
    """(file_id, line_no) -> name -> value of every data line."""
    chains, texts = chained(folder)
    out = {}
    for chain in chains.values():
        for f in chain:
            own = texts[f["file_id"]]
            for i in own:
                if i and (own[i] or "").strip(" \t\r\n") and 0 in own:
                    rows = load(f, {0: own[0], i: own[i]})[1]
                    out[f["file_id"], i] = next(iter(rows.values()))
    return out


def changes(folder):
    chains, lines = chained(folder)
    out = set()
    for chain in chains.values():
        loaded = [load(f, lines[f["file_id"]]) for f in chain]
        for f, (old_names, old_runs, old_types), (names, runs, types) in zip(chain[1:], loaded, loaded[1:], strict=False):
            gone, new = [n for n in old_names if n not in types], [n for n in names if n not in old_types]
            shared = (set(old_runs) & set(runs)) - {None}
            before = {n: n for n in types if n in old_types}
            for n in new:
                match = [g for g in gone if shared and all(equal(old_runs[s][g], runs[s][n]) for s in shared)]
                if match:
                    gone.remove(match[0])
                    before[n] = match[0]
                out.add((f["file_id"], n, "renamed" if match else "added"))
            out |= {(f["file_id"], g, "removed") for g in gone}
            out |= {(f["file_id"], n, "retyped") for n, old in before.items() if types[n] != old_types[old]}
    return out
