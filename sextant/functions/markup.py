"""Parsers of documents: sections of markup, and conversions of other formats to Markdown. Plain functions, for use in partitions."""

from __future__ import annotations

import hashlib
import json
import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser


def slug(title: str) -> str:
    return re.sub(r"[\s_]+", "-", re.sub(r"[^\w\s-]", "", title.lower()).strip()) or "section"


def _sections(path: str, content: str, heads: list[tuple[int, int, int, str]]) -> list[dict]:
    """Sections from headings (offset, offset of the body, level, title); what comes before the first is level 0."""
    if not heads or heads[0][0] > 0 and content[: heads[0][0]].strip():
        heads = [(0, 0, 0, path.rpartition("/")[2]), *heads]
    out, stack, used = [], [], {}
    for (at, body, level, title), nxt in zip(heads, [*heads[1:], (len(content), 0, 0, "")], strict=True):
        while stack and stack[-1][0] >= level:
            stack.pop()
        name = "/".join([*(s for _, s, _ in stack), slug(title)])
        n = used.get(name, 0)
        used[name] = n + 1
        ident = f"{path}::{name}" + (f"-{n + 1}" if n else "") + f"#{level}"
        text = content[body : nxt[0]].strip("\n")
        raw = content[:at].encode()
        out.append({
            "id": ident, "doc_path": path, "title": title, "level": level, "parent_id": stack[-1][2] if stack else None, "content": text, "byte_start": len(raw), "byte_end": len(content[: nxt[0]].encode()),
            "content_hash": hashlib.sha256(content[at : nxt[0]].encode()).hexdigest(), "code_blocks": [b for _, b in re.findall(r"(?ms)^```(\w*)\n(.*?)^```", text)], "tags": list(dict.fromkeys(re.findall(r"(?m)(?:^|\s)#([A-Za-z][A-Za-z0-9_-]*)", text)))})
        if level:
            stack.append((level, slug(title), ident))
    return out


def strip_mdx(content: str) -> str:
    """Without module statements and component tags outside fences."""
    out, fenced = [], False
    for line in content.split("\n"):
        fenced ^= line.startswith("```")
        if not fenced and re.match(r"\s*(?:import\s.*\sfrom\s|export\s+(?:default|const|function)\b)", line):
            continue
        out.append(line if fenced else re.sub(r"</?[A-Z]\w*(?:\s[^<>]*)?/?>", "", line))
    return "\n".join(out)


def markdown(path: str, content: str) -> list[dict]:
    heads, at, fenced, lines = [], 0, False, content.split("\n")
    for i, line in enumerate(lines):
        if re.match(r"\s{0,3}(```|~~~)", line):
            fenced = not fenced
        elif not fenced and (m := re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", line)):
            heads.append((at, at + len(line) + 1, len(m[1]), m[2]))
        elif not fenced and line.strip() and i + 1 < len(lines) and re.fullmatch(r"(=+|-{3,})\s*", lines[i + 1]) and not re.match(r"[-*>#|]", line):
            heads.append((at, at + len(line) + len(lines[i + 1]) + 2, 1 if lines[i + 1][0] == "=" else 2, line.strip()))
        at += len(line) + 1
    return _sections(path, content, heads)


def rst(path: str, content: str) -> list[dict]:
    heads, at, order, lines = [], 0, [], content.split("\n")
    for i, line in enumerate(lines):
        under = lines[i + 1] if i + 1 < len(lines) else ""
        if line.strip() and not re.fullmatch(r"([=\-~^\"'`#*+.:_])\1{2,}\s*", line) and re.fullmatch(r"([=\-~^\"'`#*+.:_])\1{2,}\s*", under) and len(under.strip()) >= len(line.strip()):
            if under[0] not in order:
                order.append(under[0])
            heads.append((at, at + len(line) + len(under) + 2, order.index(under[0]) + 1, line.strip()))
        at += len(line) + 1
    return _sections(path, content, heads)


def asciidoc(path: str, content: str) -> list[dict]:
    heads, at = [], 0
    for line in content.split("\n"):
        if m := re.match(r"(={1,6})\s+(\S.*)", line):
            heads.append((at, at + len(line) + 1, len(m[1]), m[2].strip()))
        at += len(line) + 1
    return _sections(path, content, heads)


def plain(path: str, content: str) -> list[dict]:
    """A section per paragraph."""
    heads = [(m.start(), m.start(), 1, m[0].strip().split("\n")[0][:60]) for m in re.finditer(r"(?s)\S.*?(?=\n\s*\n|\Z)", content)]
    return _sections(path, content, heads)


class _Text(HTMLParser):
    SKIP, BLOCK = {"script", "style", "template", "noscript"}, {"p", "div", "br", "li", "tr", "section", "article", "ul", "ol", "table", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in self.BLOCK:
            self.out.append("\n- " if tag == "li" else "\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]", tag) or tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html(text: str) -> str:
    p = _Text()
    p.feed(text)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(p.out))).strip()


def notebook(text: str) -> str:
    """Cells as Markdown, code cells fenced in the notebook's language; an invalid notebook is empty."""
    try:
        data = json.loads(text)
    except ValueError:
        return ""
    language = data.get("metadata", {}).get("kernelspec", {}).get("language", "python")
    cells = []
    for c in data.get("cells", []):
        source = "".join(c.get("source", [])) if isinstance(c.get("source"), list) else c.get("source", "")
        cells.append(f"```{language}\n{source}\n```" if c.get("cell_type") == "code" else source)
    return "\n\n".join(x for x in cells if x.strip())


def json_text(text: str) -> str:
    """Keys as headings, values below; comments are allowed. Invalid input is empty."""
    try:
        data = json.loads(re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.DOTALL))
    except ValueError:
        return ""

    def walk(value, level: int) -> str:
        if isinstance(value, dict):
            return "\n\n".join(f"{'#' * min(level, 6)} {k}\n\n{walk(v, level + 1)}" for k, v in value.items())
        if isinstance(value, list):
            return "\n".join(f"- {walk(v, level) if not isinstance(v, (dict, list)) else json.dumps(v, ensure_ascii=False)}" for v in value)
        return value if isinstance(value, str) else json.dumps(value)

    return walk(data, 1)


def xml_text(text: str) -> str:
    try:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", text))
    except ET.ParseError:
        return ""

    def walk(e: ET.Element, level: int) -> str:
        name = e.tag.rpartition("}")[2]
        label = e.get("id") or e.get("name")
        parts = [f"{'#' * min(level, 6)} {name}" + (f" {label}" if label else ""), (e.text or "").strip(), *(walk(c, level + 1) for c in e)]
        return "\n\n".join(p for p in parts if p)

    return walk(root, 1)


def openapi(text: str) -> list[dict]:
    """Operations and schemas of a specification in JSON or YAML: kind, name, summary, refs (schemas it names)."""
    try:
        spec = json.loads(text)
    except ValueError:
        try:
            import yaml

            spec = yaml.safe_load(text)
        except Exception:  # the parser's own errors, or no parser
            return []
    if not isinstance(spec, dict):
        return []
    refs = lambda x: sorted(set(re.findall(r"#/(?:components/schemas|definitions)/([\w.-]+)", json.dumps(x, default=str))))
    out = []
    for path, item in (spec.get("paths") or {}).items():
        for method, op in (item or {}).items():
            if method in ("get", "put", "post", "delete", "patch", "head", "options", "trace"):
                out.append({"kind": "operation", "name": f"{method.upper()} {path}", "summary": op.get("summary") or "", "refs": refs(op)})
    for name, schema in ((spec.get("components") or {}).get("schemas") or spec.get("definitions") or {}).items():
        out.append({"kind": "schema", "name": name, "summary": (schema or {}).get("description") or "", "refs": refs(schema)})
    return out


def sections(path: str, content: str) -> list[dict]:
    """Sections of a document by its extension; unknown ones are plain text."""
    kind = path.lower().rpartition(".")[2]
    if kind in ("md", "markdown"):
        return markdown(path, content)
    if kind == "mdx":
        return markdown(path, strip_mdx(content))
    if kind == "rst":
        return rst(path, content)
    if kind in ("adoc", "asciidoc"):
        return asciidoc(path, content)
    convert = {"html": html, "htm": html, "ipynb": notebook, "json": json_text, "jsonc": json_text, "xml": xml_text, "svg": xml_text}.get(kind)
    return markdown(path, convert(content)) if convert else plain(path, content)


def compress_code(content: str) -> str:
    """Fenced code without blank and comment lines."""
    return re.sub(r"(?ms)^(```\w*\n)(.*?)(^```)", lambda m: m[1] + "".join(x + "\n" for x in m[2].split("\n") if x.strip() and not re.match(r"\s*(#(?!!)|//|--\s)", x)) + m[3], content)
