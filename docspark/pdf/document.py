"""One document as plain rows: metadata, pages, runs, draws, rules, links, outline, structure, form fields."""

from __future__ import annotations

from . import fonts
from .content import Interpreter
from .errors import PdfError, page_out_of_range
from .objects import Name, Ref, Stream, number
from .reader import File

MAX_UP, MAX_OUTLINE, MAX_NAMES, MAX_STRUCT, MAX_ROLES, MAX_SPAN = 32, 32, 32, 64, 16, 1000
MAX_PAGES_READ = 2_000_000
DEFAULT_PAGE = (612.0, 792.0)
INFO = [("title", "Title"), ("author", "Author"), ("subject", "Subject"), ("keywords", "Keywords"), ("creator", "Creator"), ("producer", "Producer"), ("creation_date", "CreationDate"), ("mod_date", "ModDate")]


class Document:
    def __init__(self, data: bytes, password: str | None = None) -> None:
        self.file = File(data, password)
        self.get = self.file.get
        self.catalog: dict = self.get(self.file.trailer["Root"])
        self.page_refs: list[Ref | None] = []
        self.page_dicts: list[dict] = []
        self._collect(self.catalog.get("Pages"), set(), [])
        self.number = {ref.num: i for i, ref in reversed(list(enumerate(self.page_refs, 1))) if ref is not None}

    def _collect(self, root, seen: set[int], _up: list) -> None:
        todo = [root]
        while todo:
            x = todo.pop()
            d = self.get(x)
            if not isinstance(d, dict) or isinstance(x, Ref) and x.num in seen:
                continue
            if isinstance(x, Ref):
                seen.add(x.num)
            kids = self.get(d.get("Kids"))
            if isinstance(kids, list) and d.get("Type") != "Page":
                todo += reversed(kids)
            elif len(self.page_dicts) < MAX_PAGES_READ:
                self.page_refs.append(x if isinstance(x, Ref) else None)
                self.page_dicts.append(d)

    # Pages.

    @property
    def page_count(self) -> int:
        return len(self.page_dicts)

    def page(self, n: int) -> dict:
        if not 1 <= n <= self.page_count:
            raise page_out_of_range(n)
        return self.page_dicts[n - 1]

    def inherited(self, page: dict, key: str):
        d = page
        for _ in range(MAX_UP):
            if (got := self.get(d.get(key))) is not None:
                return got
            d = self.get(d.get("Parent"))
            if not isinstance(d, dict):
                break
        return None

    def size(self, page: dict) -> tuple[float, float]:
        box = self.inherited(page, "MediaBox")
        v = [number(self.get(x)) for x in box[:4]] if isinstance(box, list) else []
        return (abs(v[2] - v[0]), abs(v[3] - v[1])) if len(v) == 4 and None not in v else DEFAULT_PAGE

    def rotation(self, page: dict) -> int:
        got = number(self.inherited(page, "Rotate"), 0.0)
        return int(got) % 360

    def content(self, page: dict) -> bytes:
        got = self.get(page.get("Contents"))
        parts = [self.get(x) for x in got] if isinstance(got, list) else [got]
        return b"\n".join(self.file.stream_bytes(x) for x in parts if isinstance(x, Stream))

    def _resources(self, page: dict, kind: str) -> dict:
        """Entries of a resource kind, the page's own before what it inherits."""
        out: dict = {}
        d = page
        for _ in range(MAX_UP):
            own = self.get(d.get("Resources"))
            found = self.get(own.get(kind)) if isinstance(own, dict) else None
            if isinstance(found, dict):
                out = found | out
            d = self.get(d.get("Parent"))
            if not isinstance(d, dict):
                break
        return out

    def images(self, page: dict) -> dict[str, tuple[Stream, str]]:
        out = {}
        for name, ref in self._resources(page, "XObject").items():
            x = self.get(ref)
            if isinstance(x, Stream) and x.dict.get("Subtype") == "Image":
                out[name] = (x, f"{ref.num} {ref.gen}" if isinstance(ref, Ref) else name)
        return out

    def interpret(self, page: dict) -> Interpreter:
        own = self.get(page.get("Resources"))
        properties = self.get(own.get("Properties")) if isinstance(own, dict) else None

        def mcid_of(args: list) -> int | None:
            x = args[1] if len(args) > 1 else None
            if isinstance(x, Name):
                x = self.get(properties.get(x)) if isinstance(properties, dict) else None
            got = self.get(x.get("MCID")) if isinstance(x, dict) else None
            return got if type(got) is int and 0 <= got < 1 << 32 else None

        faces = {k: fonts.Font(self.file, d) for k, v in self._resources(page, "Font").items() if isinstance(d := self.get(v), dict)}
        return Interpreter(faces, self.images(page), mcid_of).run(self.content(page))

    # Metadata, destinations, outline, links.

    def metadata(self) -> dict:
        info = self.get(self.file.trailer.get("Info"))
        info = info if isinstance(info, dict) else {}
        out = {k: fonts.pdf_text(v) if isinstance(v := self.get(info.get(key)), bytes) else None for k, key in INFO}
        return out | {"page_count": self.page_count, "pdf_version": self.file.version, "encrypted": self.file.encrypted}

    def _named(self, name: bytes | str):
        key = name if isinstance(name, bytes) else str(name).encode("latin-1", "replace")
        dests = self.get(self.catalog.get("Dests"))
        if isinstance(dests, dict) and (found := self.get(dests.get(key.decode("latin-1")))) is not None:
            return found
        names = self.get(self.catalog.get("Names"))
        todo, seen = [(names.get("Dests"), 0)] if isinstance(names, dict) else [], set()
        while todo:
            x, depth = todo.pop()
            d = self.get(x)
            if not isinstance(d, dict) or depth > MAX_NAMES or isinstance(x, Ref) and x.num in seen:
                continue
            if isinstance(x, Ref):
                seen.add(x.num)
            pairs = self.get(d.get("Names")) or []
            for k, v in zip(pairs[::2], pairs[1::2], strict=False):
                if self.get(k) == key:
                    return self.get(v)
            todo += [(k, depth + 1) for k in reversed(self.get(d.get("Kids")) or [])]
        return None

    def _page_of(self, dest) -> int | None:
        for _ in range(MAX_NAMES):
            dest = self.get(dest)
            if isinstance(dest, bytes | Name):
                dest = self._named(dest)
            elif isinstance(dest, dict):
                dest = dest.get("D")
            else:
                break
        first = dest[0] if isinstance(dest, list) and dest else None
        return self.number.get(first.num) if isinstance(first, Ref) else None

    def target_page(self, d: dict) -> int | None:
        if "Dest" in d:
            return self._page_of(d["Dest"])
        action = self.get(d.get("A"))
        return self._page_of(action.get("D")) if isinstance(action, dict) and action.get("S") == "GoTo" else None

    def outline(self) -> list[dict]:
        """Rows in preorder: node_ix, parent_ix, depth, ordinal, title, page."""
        root = self.get(self.catalog.get("Outlines"))
        rows: list[dict] = []
        todo = [(root.get("First"), -1, 0, 0)] if isinstance(root, dict) else []
        seen: set[int] = set()
        while todo:
            ref, parent, depth, ordinal = todo.pop()
            d = self.get(ref)
            if not isinstance(ref, Ref) or ref.num in seen or not isinstance(d, dict) or depth > MAX_OUTLINE:
                continue
            seen.add(ref.num)
            title = self.get(d.get("Title"))
            rows.append({"node_ix": len(rows), "parent_ix": parent, "depth": depth, "ordinal": ordinal, "title": fonts.pdf_text(title) if isinstance(title, bytes) else "", "page": self.target_page(d)})
            todo.append((d.get("Next"), parent, depth, ordinal + 1))
            todo.append((d.get("First"), len(rows) - 1, depth + 1, 0))
        return rows

    def links(self, page: dict) -> list[dict]:
        out = []
        for x in self.get(page.get("Annots")) or []:
            a = self.get(x)
            if not isinstance(a, dict) or a.get("Subtype") != "Link":
                continue
            v = [number(self.get(n)) for n in (self.get(a.get("Rect")) or [])[:4]]
            if len(v) < 4 or None in v:
                continue
            action = self.get(a.get("A"))
            uri = self.get(action.get("URI")) if isinstance(action, dict) and action.get("S") == "URI" else None
            if isinstance(action, dict) and action.get("S") == "URI":
                if not isinstance(uri, bytes):
                    continue
                kind, target = {"kind": "uri", "uri": uri.decode("utf-8", "replace"), "target_page": None}, True
            else:
                target = self.target_page(a)
                kind = {"kind": "page", "uri": None, "target_page": target}
            if target is not None:
                out.append({"link_ix": len(out), "x0": min(v[0], v[2]), "y0": min(v[1], v[3]), "x1": max(v[0], v[2]), "y1": max(v[1], v[3])} | kind)
        return out

    # Logical structure.

    def structure(self) -> tuple[list[dict], list[dict]] | None:
        """(nodes in preorder, kids by marked content), or None if the document is not tagged."""
        info, ref = self.get(self.catalog.get("MarkInfo")), self.catalog.get("StructTreeRoot")
        root = self.get(ref)
        if not isinstance(info, dict) or self.get(info.get("Marked")) is not True or not isinstance(ref, Ref) or not isinstance(root, dict):
            return None
        roles = self.get(root.get("RoleMap"))
        roles = roles if isinstance(roles, dict) else {}
        nodes: list[dict] = []
        kids: list[dict] = []
        seen: set[int] = set()
        nodes.append(_node(0, -1, 0, "Root", "Root"))
        path = [(0, iter(self._kids(root)), None)]
        while path:
            at, rest, page = path[-1]
            x = next(rest, None)
            if x is None:
                nodes[at]["last_ix"] = len(nodes) - 1
                path.pop()
                continue
            d = self.get(x)
            if at and self._content_kid(x, d, at, page, kids):
                continue
            if not isinstance(x, Ref) or not isinstance(d, dict) or d.get("Type") in ("MCR", "OBJR") or x.num in seen or len(path) > MAX_STRUCT + 1:
                continue
            seen.add(x.num)
            raw = d.get("S")
            raw = str(raw) if isinstance(raw, Name) else "Unknown"
            own = d.get("Pg") if isinstance(d.get("Pg"), Ref) else page
            node = _node(len(nodes), at, len(path), self._role(raw, roles), raw)
            alt = self.get(d.get("Alt"))
            node["alt"] = fonts.pdf_text(alt) if isinstance(alt, bytes) else None
            node["page"] = self.number.get(own.num) if own is not None else None
            node |= self._spans(d)
            nodes.append(node)
            path.append((node["node_ix"], iter(self._kids(d)), own))
        return nodes, kids

    def _kids(self, d: dict) -> list:
        k = d.get("K")
        k = self.get(k) if isinstance(k, Ref) and isinstance(self.get(k), list) else k
        return k if isinstance(k, list) else [] if k is None else [k]

    def _content_kid(self, x, d, at: int, page: Ref | None, kids: list[dict]) -> bool:
        """Note a kid that is marked content; False if it may be a node."""
        mcid, where = None, page
        if type(x) is int:
            mcid = x
        elif isinstance(d, dict) and d.get("Type") == "MCR":
            got = self.get(d.get("MCID"))
            mcid = got if type(got) is int else None
            where = d["Pg"] if isinstance(d.get("Pg"), Ref) else page
        else:
            return False
        number_ = self.number.get(where.num) if where is not None else None
        if mcid is not None and 0 <= mcid < 1 << 32 and number_ is not None:
            kids.append({"node_ix": at, "kid_ix": len(kids), "page": number_, "mcid": mcid})
        return True

    def _role(self, raw: str, roles: dict) -> str:
        seen, now = {raw}, raw
        for _ in range(MAX_ROLES):
            target = self.get(roles.get(now))
            if not isinstance(target, Name) or str(target) in seen:
                return now if not isinstance(target, Name) else str(target)
            now = str(target)
            seen.add(now)
        return now

    def _spans(self, d: dict) -> dict:
        out = {"col_span": 1, "row_span": 1}
        a = self.get(d.get("A"))
        for x in a if isinstance(a, list) else [a]:
            x = self.get(x)
            if isinstance(x, dict):
                for k, key in (("col_span", "ColSpan"), ("row_span", "RowSpan")):
                    v = self.get(x.get(key))
                    if type(v) is int and v >= 0:
                        out[k] = min(max(v, 1), MAX_SPAN)
        return out

    # Forms.

    def form_fields(self) -> list[dict]:
        form = self.get(self.catalog.get("AcroForm"))
        out = []
        for ref in (self.get(form.get("Fields")) or []) if isinstance(form, dict) else []:
            d = self.get(ref)
            if isinstance(d, dict):
                name, value = self.get(d.get("T")), self.get(d.get("V"))
                text = lambda x: x.decode("utf-8", "replace") if isinstance(x, bytes) else None
                out.append({"name": text(name), "value": text(value)})
        return out


def _node(ix: int, parent: int, depth: int, tag: str, raw: str) -> dict:
    return {"node_ix": ix, "parent_ix": parent, "depth": depth, "last_ix": ix, "tag": tag, "raw_tag": raw, "alt": None, "page": None, "col_span": 1, "row_span": 1}


PARTS = ("runs", "draws", "rules", "links", "outline", "structure", "form")


def parse(data: bytes, password: str | None = None, *, pages: list[int] | None = None, max_pages: int | None = None, want: tuple[str, ...] = PARTS) -> dict:
    """One document as a nested row. pages and max_pages bound what is interpreted; want names the parts to read."""
    doc = Document(data, password)
    asked = list(range(1, doc.page_count + 1)) if pages is None else pages
    for n in asked:
        doc.page(n)
    asked = asked if max_pages is None else asked[:max_pages]
    out: dict = {"meta": doc.metadata(), "pages": [], "runs": [], "draws": [], "rules": [], "links": [], "outline": [], "nodes": [], "kids": [], "form": [], "tagged": False}
    for n in dict.fromkeys(asked):
        page = doc.page(n)
        w, h = doc.size(page)
        out["pages"].append({"page": n, "w_pt": w, "h_pt": h, "rotation": doc.rotation(page)})
        if {"runs", "draws", "rules"} & set(want):
            try:
                found = doc.interpret(page)
            except (PdfError, ValueError, IndexError, OverflowError, TypeError, KeyError, AttributeError, RecursionError) as e:
                out["pages"][-1]["error"] = f"{type(e).__name__}: {e}"[:200]
                continue
            out["runs"] += [{"page": n, "run_ix": i, "text": r[0], "x0": r[1], "y0": r[2], "x1": r[3], "y1": r[4], "font_size": r[5], "mcid": r[6]} for i, r in enumerate(found.runs)]
            ids = doc.images(page)
            out["draws"] += [{"page": n, "draw_ix": i, "obj_id": ids[name][1]} | dict(zip("abcdef", m, strict=True)) for i, (name, m) in enumerate(found.draws)]
            out["rules"] += [{"page": n, "line_ix": i, "vertical": r[0], "pos": r[1], "lo": r[2], "hi": r[3]} for i, r in enumerate(found.rules)]
        if "links" in want:
            out["links"] += [{"page": n} | x for x in doc.links(page)]
    if "outline" in want:
        out["outline"] = doc.outline()
    if "structure" in want and (tree := doc.structure()) is not None:
        out["nodes"], out["kids"], out["tagged"] = *tree, True
    if "form" in want:
        out["form"] = doc.form_fields()
    return out
