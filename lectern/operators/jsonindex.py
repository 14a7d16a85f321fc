"""Vectorised structural index of JSON records.

A batch of records is scanned as one byte array. Bitmaps of quotes, brackets and
delimiters are built with whole-array operations, nesting depth is the prefix sum
of the brackets outside strings, and every value's span, parent and position
follow from sorting the structural bytes by depth. No record is parsed one by one,
except those wrapped as a JSON text inside a JSON string, which are unwrapped first.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STRUCT = np.zeros(256, bool)
_STRUCT[[ord(c) for c in "{}[]:,"]] = True
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 13]] = True
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_ESC = np.zeros(256, bool)
_ESC[[ord(c) for c in '"\\/bfnrtu']] = True
_SCALAR = r"^(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null)$"
_OPEN_OBJ, _OPEN_ARR, _CLOSE_OBJ, _CLOSE_ARR, _COLON, _COMMA, _QUOTE, _BS = (ord(c) for c in '{[}]:,"\\')


def unwrap(js: pa.Array) -> pa.Array:
    """Replaces records that are a JSON string holding a JSON text by that text; nulls become empty."""
    js = pc.fill_null(js.cast(pa.large_string()), "")
    wrapped = np.flatnonzero(pc.match_substring_regex(js, r'^[ \t\r\n]*"').to_numpy(zero_copy_only=False))
    if not len(wrapped):
        return js
    new = []
    for s in js.take(pa.array(wrapped)).to_pylist():
        try:
            new.append(json.loads(s).encode("utf-8", "replace").decode())
        except ValueError:
            new.append("")
    mask = np.zeros(len(js), bool)
    mask[wrapped] = True
    return pc.replace_with_mask(js, pa.array(mask), pa.array(new, pa.large_string()))


def _spans(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """The byte spans [s, e) as a string array."""
    n = np.maximum(e - s, 0)
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=off[1:])
    at = np.arange(off[-1]) + np.repeat(s - off[:-1], n)
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data[at])))


def index(js: pa.Array) -> dict:
    """Structural index of a batch of JSON texts (see unwrap).

    Returns arrays over the values below the roots of all records that are valid
    JSON objects, in text order: doc (row of js), parent (index of the value that
    holds it, -1 for the root), pos (0-based position if an array element, else
    -1), kind ('s'calar, 'n'ull, 'o'bject, 'a'rray), level (1 for members of the
    root), and key and text as string arrays (key '' for array elements; text only
    of scalars, as written). valid marks the rows that are JSON objects.
    """
    js = js.cast(pa.large_string())
    nd = len(js)
    off = np.frombuffer(js.buffers()[1], np.int64)[js.offset : js.offset + nd + 1]
    raw = js.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: off[-1]] if raw is not None and nd else np.zeros(0, np.uint8)
    starts, ends = off[:-1], off[1:]
    bad = starts == ends

    def doc_of(p: np.ndarray) -> np.ndarray:
        return np.searchsorted(ends, p, side="right")

    quotes = np.flatnonzero(data[off[0] :] == _QUOTE) + off[0]
    bs = np.flatnonzero(data[off[0] :] == _BS) + off[0]
    if len(bs):  # runs of backslashes: every second byte of a run escapes what follows
        first = np.concatenate(([True], np.diff(bs) != 1))
        run_start = np.maximum.accumulate(np.where(first, bs, 0))
        escaping = (bs - run_start) % 2 == 0
        esc = bs[escaping]
        at = np.minimum(esc + 1, len(data) - 1)
        ok = _ESC[data[at]] & (esc + 1 < len(data))
        u = esc[data[at] == ord("u")]
        for k in range(2, 6):
            hex_ok = (u + k < len(data)) & _HEX[data[np.minimum(u + k, len(data) - 1)]]
            bad[np.minimum(doc_of(u[~hex_ok]), nd - 1)] = True
        bad[doc_of(esc[~ok])] = True
        escaped = np.isin(quotes, esc + 1, assume_unique=True)
        quotes = quotes[~escaped]
    qdoc = doc_of(quotes)
    per = np.bincount(qdoc, minlength=nd)
    bad |= per % 2 == 1
    keep = ~bad[qdoc]
    quotes, qdoc = quotes[keep], qdoc[keep]
    qopen, qclose = quotes[0::2], quotes[1::2]

    def in_string(p: np.ndarray) -> np.ndarray:
        return np.searchsorted(quotes, p) % 2 == 1

    ctrl = np.flatnonzero(data[off[0] :] < 32) + off[0]
    cd = doc_of(ctrl)
    bad[cd[in_string(ctrl) & ~bad[cd]]] = True

    pos = np.flatnonzero(_STRUCT[data[off[0] :]]) + off[0]
    tdoc = doc_of(pos)
    keep = ~bad[tdoc] & ~in_string(pos)
    pos, tdoc = pos[keep], tdoc[keep]
    ch = data[pos]
    is_open = (ch == _OPEN_OBJ) | (ch == _OPEN_ARR)
    is_close = (ch == _CLOSE_OBJ) | (ch == _CLOSE_ARR)

    def drop_bad() -> None:
        nonlocal pos, tdoc, ch, is_open, is_close
        keep = ~bad[tdoc]
        pos, tdoc, ch, is_open, is_close = pos[keep], tdoc[keep], ch[keep], is_open[keep], is_close[keep]

    bad |= np.bincount(tdoc, minlength=nd) == 0
    drop_bad()
    if len(pos):
        first = np.concatenate(([True], np.diff(tdoc) != 0))
        last = np.concatenate((np.diff(tdoc) != 0, [True]))
        cum = np.cumsum(is_open.astype(np.int64) - is_close)
        depth = cum - np.repeat((cum - 1)[first], np.diff(np.append(np.flatnonzero(first), len(pos))))  # a record that opens starts at 1
        bad[tdoc[first & (ch != _OPEN_OBJ)]] = True
        bad[tdoc[(depth < 0) | (last & (depth != 0)) | (~last & (depth == 0))]] = True
        drop_bad()
    ntok = len(pos)
    if ntok == 0:
        z = np.zeros(0, np.int64)
        return {"doc": z, "parent": z, "pos": z, "kind": np.zeros(0, "U1"), "level": z, "key": pa.array([], pa.large_string()), "text": pa.array([], pa.large_string()), "valid": ~bad & False}
    first = np.concatenate(([True], np.diff(tdoc) != 0))
    last = np.concatenate((np.diff(tdoc) != 0, [True]))
    depth = np.cumsum(is_open.astype(np.int64) - is_close)
    # Bytes of one container come together when sorted by (its depth, position); an opening bracket leads its own.
    level = np.where(is_close, depth + 1, depth)
    order = np.argsort(level, kind="stable")
    idx = np.arange(ntok)
    lead = np.maximum.accumulate(np.where(is_open[order], idx, 0))
    container = np.empty(ntok, np.int64)
    container[order] = order[lead]
    commas = np.cumsum(ch[order] == _COMMA)
    nth = np.empty(ntok, np.int64)
    nth[order] = commas - commas[lead]
    in_arr = ch[container] == _OPEN_ARR
    bad[tdoc[is_close & (ch != np.where(in_arr, _CLOSE_ARR, _CLOSE_OBJ))]] = True

    # The gap after each byte up to the next: empty, a string, or another scalar.
    gs, ge = pos + 1, np.where(last, ends[tdoc], np.append(pos[1:], 0))
    while (m := (gs < ge) & _WS[data[np.minimum(gs, len(data) - 1)]]).any():
        gs = gs + m
    while (m := (gs < ge) & _WS[data[np.maximum(ge - 1, 0)]]).any():
        ge = ge - m
    empty = gs >= ge
    is_str = ~empty & (data[np.minimum(gs, len(data) - 1)] == _QUOTE)
    at = np.minimum(np.searchsorted(qopen, gs), max(len(qopen) - 1, 0))
    if len(qopen):
        whole = (qopen[at] == gs) & (qclose[at] == ge - 1)
        bad[tdoc[is_str & ~whole]] = True
    other = np.flatnonzero(~empty & ~is_str)
    txt = _spans(data, gs[other], ge[other])
    ok = pc.match_substring_regex(txt, _SCALAR).to_numpy(zero_copy_only=False)
    bad[tdoc[other[~ok]]] = True
    is_null = np.zeros(ntok, bool)
    is_null[other] = pc.equal(txt, "null").to_numpy(zero_copy_only=False)
    head = pos[first]  # nothing but blanks before the first byte
    lead_ws = np.where(_WS[data], 0, 1)
    cw = np.concatenate(([0], np.cumsum(lead_ws)))
    bad[tdoc[first][cw[head] != cw[starts[tdoc[first]]]]] = True

    nxt = np.append(ch[1:], 0)
    nxt[last] = 0
    nopen = (nxt == _OPEN_OBJ) | (nxt == _OPEN_ARR)
    key_gap = is_str & (nxt == _COLON)
    value = (ch == _COLON) | ((ch == _COMMA) & in_arr) | (ch == _OPEN_ARR)
    after = np.where(in_arr, _CLOSE_ARR, _CLOSE_OBJ)
    good = np.where(
        value,
        (~empty & ((nxt == _COMMA) | (nxt == after))) | (empty & nopen) | ((ch == _OPEN_ARR) & empty & (nxt == _CLOSE_ARR)),
        np.where(
            ch == _OPEN_OBJ,
            key_gap | (empty & (nxt == _CLOSE_OBJ)),
            np.where(ch == _COMMA, key_gap, empty & ((nxt == _COMMA) | (nxt == _CLOSE_OBJ) | (nxt == _CLOSE_ARR) | last)),
        ),
    )
    bad[tdoc[~good]] = True
    valid = ~bad

    node = np.flatnonzero(value & ~(empty & ~nopen) & valid[tdoc])
    kind = np.where(empty[node], np.where(nxt[node] == _OPEN_OBJ, "o", "a"), np.where(is_null[node], "n", "s"))
    node_of_open = np.full(ntok + 1, -1, np.int64)
    holds = np.flatnonzero(empty[node])
    node_of_open[node[holds] + 1] = holds
    member = ch[node] == _COLON
    key = np.where(member, node - 1, 0)
    keys = _spans(data, np.where(member, gs[key] + 1, 0), np.where(member, ge[key] - 1, 0))
    if pc.any(pc.match_substring(keys, "\\")).as_py():
        keys = pa.array([json.loads(f'"{k}"') if "\\" in k else k for k in keys.to_pylist()], pa.large_string())
    text = _spans(data, np.where(empty[node], 0, gs[node]), np.where(empty[node], 0, ge[node]))
    return {
        "doc": tdoc[node],
        "parent": node_of_open[container[node]],
        "pos": np.where(member, -1, nth[node]),
        "kind": kind,
        "level": level[node],
        "key": keys,
        "text": text,
        "valid": valid,
    }


def item_paths(ix: dict, list_fields: tuple[str, ...], list_parents: tuple[str, ...]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Path of every value, which values are non-null array elements, and their positions.

    A value that stands bare in a field of list_fields, or in any field of an object
    under list_parents, counts as element 0 of that field's array.
    """
    n = len(ix["doc"])
    is_elem = ix["pos"] >= 0
    parent, level, keys = ix["parent"], ix["level"], ix["key"]
    listy = pc.is_in(keys, pa.array(list_fields, pa.large_string())).to_numpy(zero_copy_only=False) & ~is_elem
    under = pc.is_in(keys, pa.array(list_parents, pa.large_string())).to_numpy(zero_copy_only=False) & (ix["kind"] == "o")
    listy |= ~is_elem & (parent >= 0) & np.append(under, False)[parent]
    bare = listy & ((ix["kind"] == "s") | (ix["kind"] == "o"))
    pos = np.where(bare, 0, ix["pos"])
    text, none = pa.large_string(), pa.scalar("", pa.large_string())
    at = pc.binary_join_element_wise(pa.scalar("[", text), pa.array(np.maximum(pos, 0)).cast(text), pa.scalar("]", text), none)
    own = pc.if_else(pa.array(is_elem), at, pc.if_else(pa.array(bare), pc.binary_join_element_wise(keys, at, none), keys))
    paths = np.empty(n, object)
    own_np = own.to_numpy(zero_copy_only=False)
    for lv in range(1, int(level.max()) + 1 if n else 1):
        rows = np.flatnonzero(level == lv)
        up = parent[rows]
        root = up < 0
        paths[rows[root]] = own_np[rows[root]]
        rows, up = rows[~root], up[~root]
        if len(rows):
            dot = np.where(is_elem[rows], "", ".").astype(object)
            paths[rows] = paths[up] + dot + own_np[rows]
    return pa.array(paths, pa.large_string()), (is_elem | bare) & (ix["kind"] != "n"), pos
