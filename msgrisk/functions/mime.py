"""One walk over a raw message: bytes in, entity rows out.

The walk only decodes. Identity, routing, authentication and attachment checks are column
expressions over the exploded entity tables (``operators.mail``).
"""

from __future__ import annotations

from email import policy
from email.headerregistry import HeaderRegistry
from email.parser import BytesParser
from email.utils import getaddresses
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED_TYPES = ("message/rfc822", "message/global")

_S = T.StringType()
_STEP = T.StructType().add("grp", T.IntegerType()).add("branch", T.IntegerType())
_HEADER = (T.StructType().add("name", _S).add("value", _S).add("ord", T.IntegerType())
           .add("mailboxes", T.ArrayType(T.StructType().add("display", _S).add("address", _S))))
_PART = (T.StructType().add("part_ord", T.IntegerType()).add("content_type", _S).add("content", _S)
         .add("alternative_path", T.ArrayType(_STEP)))
_FILE = T.StructType().add("filename", _S).add("content_type", _S)
ENTITY = (T.StructType().add("msg_path", T.ArrayType(T.IntegerType())).add("headers", T.ArrayType(_HEADER))
          .add("parts", T.ArrayType(_PART)).add("attachments", T.ArrayType(_FILE)).add("warnings", T.ArrayType(_S)))

ADDRESS_HEADERS = ("from", "to", "cc", "reply-to", "return-path")
KEPT_HEADERS = (*ADDRESS_HEADERS, "subject", "authentication-results")


class _ParsedHeaders(HeaderRegistry):
    """Header values as objects, each parsed once: the parser and the entity walk ask for the same few ones again and again."""

    def __init__(self):
        super().__init__()
        self._kept = lru_cache(maxsize=1024)(super().__call__)

    def __call__(self, name, value):
        return self._kept(name, value) if len(value) <= 1000 else super().__call__(name, value)


POLICY = policy.default.clone(header_factory=_ParsedHeaders())


def _parse(raw: bytes):
    """The message, and whether its nesting was too deep for the parser (then only its headers are read)."""
    try:
        return BytesParser(policy=POLICY).parsebytes(raw), False
    except RecursionError:
        outer = BytesParser(policy=POLICY).parsebytes(raw, headersonly=True)
        outer.set_payload("")
        return outer, True


def _headers(message, warnings):
    rows = []
    for name, raw in message.raw_items():
        if name.lower() not in KEPT_HEADERS:
            continue
        try:
            value = str(message.policy.header_fetch_parse(name, raw))
        except Exception:  # noqa: BLE001 - malformed headers raise many types
            value = str(raw)
            warnings.append("unparsed_header")
        boxes = getaddresses([value]) if name.lower() in ADDRESS_HEADERS else []
        rows.append({"name": name.lower(), "value": value, "ord": len(rows),
                     "mailboxes": [{"display": d, "address": a} for d, a in boxes if a]})
    return rows


def _text(part, warnings):
    try:
        return str(part.get_content(errors="strict"))
    except Exception:  # noqa: BLE001 - unknown charsets and broken encodings
        warnings.append("decoding_fallback")
        payload = part.get_payload(decode=True) or b""
        try:
            return payload.decode(part.get_content_charset() or "utf-8", errors="replace")
        except LookupError:
            return payload.decode("utf-8", errors="replace")


def _entity(message, path):
    """Leaves of one message; attached messages are returned for their own entity."""
    warnings, parts, files, nested, groups = [], [], [], [], 0
    todo = [(message, ())]
    while todo:
        part, steps = todo.pop()
        kind = part.get_content_type()
        if part.defects:
            warnings.append("malformed_structure")
        names = [n.lower() for n, _ in part.raw_items()]
        if any(names.count(n) > 1 for n in ("content-type", "content-transfer-encoding", "content-disposition")):
            warnings.append("duplicate_mime_header")
        if kind in NESTED_TYPES:
            files.append({"filename": part.get_filename() or "attached.eml", "content_type": kind})
            children = part.get_payload()
            nested += children if isinstance(children, list) else []
            warnings += [] if isinstance(children, list) and children else ["unparsed_attached_message"]
        elif part.is_multipart():
            children = part.get_payload()
            if kind == "multipart/alternative":
                forks = [(c, (*steps, {"grp": groups, "branch": i})) for i, c in enumerate(children)]
                groups += 1
            else:
                forks = [(c, steps) for c in children]
            todo += reversed(forks)
        elif part.get_filename() or part.get_content_disposition() == "attachment" or kind not in ("text/plain", "text/html"):
            files.append({"filename": part.get_filename() or "unnamed", "content_type": kind})
        else:
            content = _text(part, warnings)
            if not any(p["content_type"] == kind and p["content"] == content for p in parts):
                parts.append({"part_ord": len(parts), "content_type": kind, "content": content, "alternative_path": list(steps)})
    row = {"msg_path": list(path), "headers": _headers(message, warnings), "parts": parts,
           "attachments": files, "warnings": warnings}
    return row, nested


def read_message(raw: bytes) -> list[dict]:
    """One row for the message and one for each message attached to it, however deep."""
    message, limited = _parse(raw)
    rows, queue = [], [(message, ())]
    while queue:
        current, path = queue.pop(0)
        row, nested = _entity(current, path)
        queue += [(child, (*path, i)) for i, child in enumerate(nested)]
        row["warnings"] = sorted({*row["warnings"], *(["mime_limit"] if limited and not path else [])})
        rows.append(row)
    return rows


@F.pandas_udf(T.ArrayType(ENTITY))
def message_entities(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: [] if b is None else read_message(bytes(b)))
