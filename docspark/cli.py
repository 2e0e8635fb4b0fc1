"""python -m docspark.cli: one document at a time, without a Spark session.

extract (the default), render, chunk, outline, structure, figures. `-` reads the standard input. Exit codes: 0 done, 1 an
error of the document or the system, 2 a wrong call, 3 a password is needed or wrong."""

from __future__ import annotations

import argparse
import json
import sys

from .core import single
from .pdf.document import Document, parse
from .pdf.errors import PdfError
from .pdf.image import encode_png


def _read(path: str) -> bytes:
    if path == "-":
        return sys.stdin.buffer.read()
    with open(path, "rb") as f:
        return f.read()


def _password(args: argparse.Namespace) -> str | None:
    if args.password is not None or args.password_file is None:
        return args.password
    with open(args.password_file, encoding="utf-8") as f:
        return f.read().strip()


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docspark", description="Text, chunks, trees and images of a PDF document")
    sub = top.add_subparsers(dest="command", required=True)
    made = {}
    for name in ("extract", "render", "chunk", "outline", "structure", "figures"):
        p = made[name] = sub.add_parser(name)
        p.add_argument("file")
        p.add_argument("--password")
        p.add_argument("--password-file")
    made["extract"].add_argument("--json", action="store_true")
    made["extract"].add_argument("--max-pages", type=int, default=20)
    made["render"].add_argument("--page", type=int, default=1)
    made["render"].add_argument("--out", "-o")
    made["render"].add_argument("--dpi", type=float)
    made["render"].add_argument("--backend", choices=["auto", "native", "pdfium"], default="auto")
    made["chunk"].add_argument("--format", choices=["json", "md", "text"], default="json")
    made["chunk"].add_argument("--target-tokens", type=int, default=512)
    made["chunk"].add_argument("--overlap-tokens", type=int, default=0)
    made["chunk"].add_argument("--context", action="store_true")
    return top


def _markdown(chunks: list[dict]) -> str:
    from .core.markdown import to_markdown

    return to_markdown(chunks)


def _run(args: argparse.Namespace) -> str | bytes:
    data, password = _read(args.file), _password(args)
    if args.command == "extract":
        got = parse(data, password, max_pages=args.max_pages, want=("runs",))
        text, cut = single.join_capped(single.page_texts(got), 200_000)
        out = {"text": text, "pages_processed": [p["page"] for p in got["pages"]], "images": [], "truncated": {"text": cut, "images": False}}
        return json.dumps(out, indent=2, ensure_ascii=False) if args.json else text
    if args.command == "render":
        from .operators.render import renderer

        return encode_png(renderer(args.backend)().render(Document(data, password), args.page, {"dpi": args.dpi} if args.dpi else {}))
    if args.command == "chunk":
        made = single.chunk_document(data, password, target_tokens=args.target_tokens, overlap_tokens=args.overlap_tokens, contextual_prefix=args.context)
        return {"json": single.to_json, "md": _markdown, "text": single.document_text}[args.format](made)
    got = parse(data, password)
    tree = {"outline": lambda: single.outline_tree(got["outline"]), "structure": lambda: single.structure_tree(got) or {"tagged": False}, "figures": lambda: single.figures(got)}[args.command]()
    return json.dumps(tree, indent=2, ensure_ascii=False)


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    commands = ("extract", "render", "chunk", "outline", "structure", "figures", "-h", "--help")
    if not any(a in commands for a in argv[:1]):
        argv = ["extract", *argv]
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        out = _run(args)
    except PdfError as e:
        print(f"{e.code}: {e.message}", file=sys.stderr)
        return 3 if e.code == "password_required_or_incorrect" else 1
    except OSError as e:
        print(e, file=sys.stderr)
        return 1
    if isinstance(out, bytes):
        if args.out:
            with open(args.out, "wb") as f:
                f.write(out)
        else:
            sys.stdout.buffer.write(out)
    else:
        print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
