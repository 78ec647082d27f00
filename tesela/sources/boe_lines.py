"""Raw gazette lines to records, with the lines that cannot be loaded and why.

Strict load plus anti-join: every line keeps its offset (id, file and line number); only conforming
lines are loaded; the loaded offsets are subtracted from the raw ones; what remains is diagnosed.
"""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.session import stage_table

#: Slots of a line, in order.
SLOTS = ("institution", "buyer_name", "file_number", "date", "record_type", "contract_nature", "object", "procedure", "region", "cpv_subjects", "cpv_codes_raw", "estimated_value_raw", "awarded_value_raw", "supplier_name", "source_url")
QUOTING, FIELD_COUNT, VALUE = "quoting", "field_count", "value"
RECORD = (
    "contract_id string, notice_id string, institution string, buyer_name string, file_number string, publication_date string, publication_year int, record_type string, contract_nature string, object string, procedure string, region string, "
    "cpv_subjects string, cpv_codes_raw string, cpv_code_list array<string>, is_cpv_71 boolean, estimated_value_raw string, estimated_value_eur double, awarded_value_raw string, awarded_value_eur double, supplier_name string, source_url string, "
    "source_file string, source_line int, raw_field_count int, repaired_columns boolean, parser_warning string"
)
_AMOUNT = re.compile(r"\d{1,3}(?:\.\d{3})*,\d{2} euros?", re.I)
_CODE = re.compile(r"\d{8}")
_CODES = re.compile(r"\d{8}(?:\s*,\s*\d{8})*")
_DATE = re.compile(r"(\d\d)/(\d\d)/(\d{4})")
_EUROS = re.compile(r"\d\d euros?", re.I)
_WHOLE = re.compile(r"\d{1,3}(?:\.\d{3})*")
_RUNS = re.compile('"+')


def unwrap(line: str) -> str:
    """Without trailing semicolons and, where the line is quoted as a whole, without that layer."""
    s = line.rstrip("\r\n")
    s = re.sub(r"[;\s]+$", "", s)
    if len(s) >= 2 and s[0] == '"' and s[-1] == '"' and all(len(m) % 2 == 0 for m in _RUNS.findall(s[1:-1])):
        inner = s[1:-1].replace('""', '"')
        if "," in inner:
            return inner
    return s


def split_strict(s: str) -> list[str] | None:
    """Fields of strict CSV; None where a quote is never closed or text stands beside one."""
    if '"' not in s:
        return s.split(",")
    fields, i, n = [], 0, len(s)
    while True:
        if i < n and s[i] == '"':
            j, parts = i + 1, []
            while True:
                k = s.find('"', j)
                if k < 0:
                    return None
                parts.append(s[j:k])
                if s.startswith('""', k):
                    parts.append('"')
                    j = k + 2
                    continue
                break
            fields.append("".join(parts))
            i = k + 1
            if i < n and s[i] != ",":
                return None
        else:
            k = s.find(",", i)
            k = n if k < 0 else k
            if '"' in s[i:k]:
                return None
            fields.append(s[i:k])
            i = k
        if i >= n:
            return fields
        i += 1


def _capitals(x: str) -> bool:
    return any(c.isalpha() for c in x) and x == x.upper()


def _doubled(fields: list[str]) -> list[str]:
    """Fields with doubled commas inside a text put together: an empty field before one that begins with a blank."""
    if "" not in fields:
        return fields
    out: list[str] = []
    for i, f in enumerate(fields):
        if out and (f == "" and i + 1 < len(fields) and fields[i + 1].startswith(" ") and fields[i + 1].strip() or i > 1 and fields[i - 1] == "" and f.startswith(" ") and f.strip()):
            out[-1] += "," + f
        else:
            out.append(f)
    return out


def repair(fields: list[str]) -> list[str] | None:
    """Fields joined again to 15 where unquoted commas inside slots are the only cause.

    A field that begins with a blank continues the one before it, also past a doubled comma. The institution is in capitals, so the
    first field that is not is the buyer; from the right, the address, the supplier, two amounts (cut at the
    decimal comma or not), the codes, the subject, one region and one procedure are taken, and the object is
    what remains.
    """
    fields = _doubled(fields)
    n = len(fields)
    k = 1
    while k < n and (fields[k].startswith(" ") or _capitals(fields[k])):
        k += 1
    if k + 4 >= n or any(not f.strip() for f in fields) or any("://" in f for f in fields[:-1]) or sum(bool(_DATE.fullmatch(f)) for f in fields) > 1:
        return None
    head, tail = [",".join(fields[:k]), *fields[k : k + 5]], fields[k + 5 :]
    if len(head) != 6 or any(f.startswith(" ") for f in head[1:]):
        return None
    end = len(tail) - 1
    for a in range(end - 1, 5, -1):  # the supplier starts at a
        if any(not f.startswith(" ") for f in tail[a + 1 : end]) or tail[a].startswith(" "):
            continue
        for w2 in (2, 1):
            if not _amount_like(tail[a - w2 : a]):
                continue
            for w1 in (2, 1):
                b = a - w2 - w1
                if b < 5 or not _amount_like(tail[b : a - w2]):
                    continue
                c = b - 1
                while c > 0 and (tail[c].startswith(" ") or (_CODE.fullmatch(tail[c].strip()) and _CODE.fullmatch(tail[c - 1].strip()))):
                    c -= 1
                s = c - 1
                while s > 0 and tail[s].startswith(" "):
                    s -= 1
                if s < 3 or any(f.startswith(" ") for f in tail[s - 2 : s]):
                    continue
                return [*head, ",".join(tail[: s - 2]), tail[s - 2], tail[s - 1], ",".join(tail[s:c]), ",".join(tail[c:b]), ",".join(tail[b : a - w2]), ",".join(tail[a - w2 : a]), ",".join(tail[a:end]), tail[end]]
    return None


def _amount_like(parts: list[str]) -> bool:
    if len(parts) == 2:
        return bool(_WHOLE.fullmatch(parts[0].strip()) and _EUROS.fullmatch(parts[1]))
    return parts[0].lower().strip() == "no disponible" or ("euro" in parts[0].lower() and not _EUROS.fullmatch(parts[0])) or parts[0].strip() == ""


def _day(text: str) -> dt.date | None:
    if m := _DATE.fullmatch(text.strip()):
        try:
            return dt.date(int(m[3]), int(m[2]), int(m[1]))
        except ValueError:
            pass
    return None


def _money_ok(text: str) -> bool:
    t = text.strip()
    return t.lower() == "no disponible" or bool(_AMOUNT.fullmatch(t))


def euros(text: str) -> float | None:
    t = text.strip()
    return float(t.split(" ")[0].replace(".", "").replace(",", ".")) if _AMOUNT.fullmatch(t) else None


def conforming(line: str | None) -> tuple[list[str], int] | None:
    """The strict load: 15 slots and the raw number of fields, or None."""
    if line is None:
        return None
    fields = split_strict(unwrap(line))
    if fields is None or len(fields) < 15:
        return None
    n = len(fields)
    if n > 15 and (fields := repair(fields)) is None:
        return None
    return (fields, n) if not _bad_value(fields) else None


def _bad_value(f: list[str]) -> bool:
    return not (_day(f[3]) and _money_ok(f[11]) and _money_ok(f[12]) and _CODES.fullmatch(f[10].strip()) and f[14].strip().startswith(("http://", "https://")))


def reason_of(line: str | None) -> str:
    """Why a line is not loaded; the first reason that applies. Null and blank lines lack fields."""
    fields = split_strict(unwrap(line or ""))
    if fields is None:
        return QUOTING
    if len(fields) < 15 or len(fields) > 15 and repair(fields) is None:
        return FIELD_COUNT
    return VALUE


def _record(line: str, file: str, number: int, fields: list[str], n: int) -> dict:
    f = dict(zip(SLOTS, (x.strip() for x in fields), strict=True))
    day = _day(f["date"])
    notice = m[1] if (m := re.search(r"[?&]id=([^&#]+)", f["source_url"])) else None
    codes = list(dict.fromkeys(re.findall(r"\d{8}", f["cpv_codes_raw"])))
    warnings = [f"reparada_desde_{n}_campos"] * (n != 15) + ["caracteres_reemplazados_por_codificacion"] * ("�" in line)
    del f["date"]
    return f | {
        "contract_id": notice or f"{f['file_number']}|{day}|{number}", "notice_id": notice, "publication_date": str(day), "publication_year": day.year, "cpv_code_list": codes, "is_cpv_71": any(c.startswith("71") for c in codes),
        "estimated_value_eur": euros(f["estimated_value_raw"]), "awarded_value_eur": euros(f["awarded_value_raw"]), "source_file": file, "source_line": number, "raw_field_count": n, "repaired_columns": n != 15, "parser_warning": ";".join(warnings) or None,
    }


def load_strict(lines: DataFrame) -> DataFrame:
    """line_id and the 27 record fields of every conforming line.

    lines: line_id, source_file, source_line, line; other columns are ignored. An empty table gives an empty
    one; repeated lines load once each, as offsets differ.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]

    def load(batches):
        for b in batches:
            rows = []
            for i, file, number, line in zip(b["line_id"], b["source_file"], b["source_line"], b["line"], strict=True):
                if (got := conforming(line)) is not None:
                    rows.append({"line_id": i} | _record(line, file, number, *got))
            out = pd.DataFrame(rows, columns=["line_id", *names])
            for c in ("publication_year", "raw_field_count", "source_line"):
                out[c] = out[c].astype("Int32")
            yield out

    return lines.select("line_id", "source_file", "source_line", "line").mapInPandas(load, f"line_id bigint, {RECORD}")


def rejected(lines: DataFrame, loaded: DataFrame) -> DataFrame:
    """line_id and reason of the raw offsets that were not loaded (left anti-join on the offset, then diagnosis)."""

    @F.pandas_udf("string")
    def reason(s: pd.Series) -> pd.Series:
        return s.map(reason_of, na_action=None)

    # only offsets meet in the anti-join; the texts of the few that remain are fetched afterwards
    rest = stage_table(lines.select("line_id").join(loaded.select("line_id"), "line_id", "left_anti"), "rejected")
    return lines.select("line_id", "line").join(rest.distinct(), "line_id").select("line_id", reason("line").alias("reason"))
