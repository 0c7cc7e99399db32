"""Reader of Swift's intermediate language (canonical stage), a line at a time.

Each instruction becomes no, one or several raw statements, or an alias: then its result is a name
for its operand. Lines outside functions, tables and globals are skipped.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from io import StringIO
from itertools import batched, chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import small_batches, spread, stored
from .ir_model import FUNCTION, Block, Function, UnsupportedInstruction, canonical, stmt
from .ir_text import AT_ONCE, ParseError

# What instructions come to. Those of the same effect stand together.
NEW_POINTER = "alloc_stack alloc_box alloc_value_buffer".split()
NEW = "alloc_ref alloc_ref_dynamic metatype value_metatype existential_metatype objc_protocol object alloc_existential_box init_block_storage_header keypath".split()
NOTHING = (
    "alloc_global dealloc_stack dealloc_box dealloc_ref dealloc_partial_ref dealloc_value_buffer end_borrow end_lifetime destroy_addr bind_memory end_access "
    "end_unpaired_access strong_retain strong_release set_deallocating strong_retain_unowned unowned_retain unowned_release fix_lifetime abort_apply end_apply "
    "retain_value retain_value_addr unmanaged_retain_value release_value release_value_addr unmanaged_release_value destroy_value autorelease_value "
    "unmanaged_autorelease_value deinit_existential_addr dealloc_existential_box unconditional_checked_cast_addr"
).split()
ALIAS = (
    "project_box begin_borrow index_addr index_raw_pointer begin_access begin_unpaired_access mark_dependence end_cow_mutation strong_copy_unmanaged_value "
    "init_existential_addr open_existential_addr init_existential_ref open_existential_ref init_existential_metatype open_existential_metatype project_existential_box "
    "open_existential_box project_block_storage upcast address_to_pointer pointer_to_address unchecked_ref_cast unchecked_addr_cast unchecked_trivial_bit_cast "
    "unchecked_bitwise_cast unchecked_ownership_conversion ref_to_raw_pointer raw_pointer_to_ref ref_to_unowned unowned_to_ref ref_to_unmanaged unmanaged_to_ref "
    "convert_function convert_escape_to_noescape classify_bridge_object value_to_bridge_object ref_to_bridge_object bridge_object_to_ref bridge_object_to_word "
    "thin_to_thick_function thick_to_objc_metatype objc_to_thick_metatype objc_metatype_to_object objc_existential_metatype_to_object unconditional_checked_cast"
).split()
ASSIGN = "copy_unowned_value strong_copy_unowned_value copy_block copy_block_without_escaping copy_value ref_tail_addr".split()
READ = "load load_borrow load_weak load_unowned".split()
WRITE = "store store_weak store_unowned".split()
COPY_ADDRESS = "copy_addr unchecked_ref_cast_addr".split()
UNARY = "is_unique is_escaping_closure".split()
FUNCTION_REFERENCE = "function_ref dynamic_function_ref prev_dynamic_function_ref".split()
DYNAMIC = "class_method super_method".split()
FOREIGN = "objc_method objc_super_method".split()
UNSUPPORTED = (
    "get_async_continuation get_async_continuation_addr hop_to_executor extract_executor dealloc_stack_ref project_value_buffer increment_profiler_counter "
    "explicit_copy_addr tail_addr rebind_memory global_value base_addr_to_offset explicit_copy_value move_value init_existential_value deinit_existential_value "
    "open_existential_value open_existential_box_value unchecked_value_cast thin_function_to_pointer pointer_to_thin_function unconditional_checked_cast_value "
    "checked_cast_value_br await_async_continuation differentiable_function linear_function differentiable_function_extract linear_function_extract "
    "differentiability_witness_function mark_must_check copyable_to_moveonlywrapper moveonlywrapper_to_copyable"
).split()
# Field names of well-known structs, in the order of their initialisers.
STRUCT_FIELDS = {
    "Int": ["_value"], "Int8": ["_value"], "Int16": ["_value"], "Int32": ["_value"], "Int64": ["_value"],
    "UInt": ["_value"], "UInt8": ["_value"], "UInt16": ["_value"], "UInt32": ["_value"], "UInt64": ["_value"],
    "Bool": ["_value"], "Double": ["_value"], "Float": ["_value"],
}

_DEF = re.compile(r"^sil (?:[^@]*?)@(\S+) : (.*?)( \{)?\s*$")
_BLOCK = re.compile(r"^(bb\d+)(?:\((.*)\))?:")
_LINE = re.compile(r"^  (?:(\(?%[^=]*?\)?) = )?([a-z_]+)\b ?(.*)$")
_LOC = re.compile(r', loc (?:\*?"((?:[^"\\]|\\.)*)":(\d+):(\d+)|\S+)')
_VALUE = re.compile(r"%\d+")
_TEXT = re.compile(r'"((?:[^"\\]|\\.)*)"')


def hex_float(bits: str) -> float:
    """A float literal's bit pattern; what a signed 64-bit number can't hold is 0.0."""
    try:
        n = int(bits, 16)
        return struct.unpack(">d", struct.pack(">q", n))[0] if len(bits.removeprefix("0x")) > 8 else struct.unpack(">f", struct.pack(">i", n))[0]
    except (ValueError, struct.error):
        return 0.0


def pointer(t: str) -> str:
    return t if t.startswith("*") else f"*{t}"


def pointee(t: str) -> str:
    return t.removeprefix("*")


def split_types(text: str) -> list[str]:
    """The parts of a list between commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "(<[{":
            depth += 1
        elif c in ")]}" or c == ">" and text[i - 1] != "-":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    last = text[start:].strip()
    return [*out, last] if last else out


def result_type(function_type: str) -> str:
    """What follows the last arrow outside brackets."""
    depth, at = 0, -1
    for i, c in enumerate(function_type):
        if c in "(<[{":
            depth += 1
        elif c in ")]}" or c == ">" and function_type[i - 1] != "-":
            depth -= 1
        elif c == ">" and depth == 0:
            at = i
    return function_type[at + 1 :].strip() if at >= 0 else function_type


def last_type(rest: str) -> str:
    """The type after the last ` : $`, or the first `$`."""
    at = rest.rfind(" : $")
    if at >= 0:
        return rest[at + 4 :].strip()
    at = rest.find("$")
    return split_types(rest[at + 1 :])[0] if at >= 0 else "Any"


class _Body:
    """The statements of a function under construction."""

    def __init__(self, module: str):
        self.module, self.alias, self.rename, self.extra, self.n = module, {}, {}, [], 0
        self.builtins: dict[str, int] = {}

    def value(self, name: str) -> str:
        while name in self.alias:
            name = self.alias[name]
        return name

    def values(self, text: str) -> list[str]:
        return [self.value(v) for v in _VALUE.findall(text)]

    def fresh(self, base: str) -> str:
        self.n += 1
        return f"{base}s{self.n}"


def instruction(body: _Body, results: list[str], word: str, rest: str, pos) -> list[dict]:
    """The raw statements of an instruction."""
    v = body.values(rest)
    r = results[0] if results else None
    t = last_type(rest)
    s = lambda kind, **k: stmt(kind, pos, **k)
    new = lambda name, type_: s("new", result=name, result_type=type_, alloc_type=type_)
    if word in UNSUPPORTED:
        raise UnsupportedInstruction(f"{body.module}: {word}")
    if word in NOTHING:
        return []
    if word in ALIAS:
        if r and v:
            body.alias[r] = v[0]
        return []
    if word in ("debug_value", "debug_value_addr"):
        m = re.search(r'name "([^"]*)"', rest)
        if m and v:
            body.rename.setdefault(v[0], m[1])
        return []
    if word in NEW_POINTER:
        return [new(r, pointer(t))]
    if word in NEW:
        return [new(r, t)]
    if word in ASSIGN:
        return [s("assign", result=r, result_type=t, src=v[0])]
    if word in READ:
        return [s("pointer_read", result=r, result_type=pointee(t), obj=v[0])]
    if word in WRITE:
        return [s("pointer_write", src=v[0], obj=v[1], field_attr="weak" if word == "store_weak" else None)]
    if word == "store_borrow":
        out = [s("pointer_write", src=v[0], obj=v[1])]
        return out + ([s("assign", result=r, result_type=t, src=v[1])] if r else [])
    if word in COPY_ADDRESS:
        x = body.fresh(v[0])
        return [s("pointer_read", result=x, result_type=pointee(t), obj=v[0]), s("pointer_write", src=x, obj=v[1])]
    if word in UNARY:
        return [s("unary_op", result=r, result_type="Builtin.Int1", field_attr="arb", args=v[:1])]
    if word == "begin_cow_mutation":
        body.alias[results[1]] = v[0]
        return [s("unary_op", result=r, result_type="Builtin.Int1", field_attr="arb", args=v[:1])]
    if word in FUNCTION_REFERENCE:
        return [s("function_ref", result=r, result_type=t, fn_name=re.search(r"@(\S+)", rest)[1])]
    if word == "global_addr":
        return [s("singleton_read", result=r, result_type=t, static_key=f"Globals_{body.module}.{re.search(r'@(\S+)', rest)[1]}")]
    if word == "integer_literal":
        return [s("literal", result=r, result_type=split_types(rest)[0].removeprefix("$"), lit_int=str(int(split_types(rest)[1].split(" ")[0], 0)))]
    if word == "float_literal":
        return [s("literal", result=r, result_type=split_types(rest)[0].removeprefix("$"), lit_float=hex_float(split_types(rest)[1].split(" ")[0]))]
    if word == "string_literal":
        return [s("literal", result=r, result_type="Builtin.RawPointer", lit_str=_TEXT.search(rest)[1])]
    if word in DYNAMIC or word == "witness_method":
        index = re.search(r"#([^\s,:]+)", rest)[1]
        ref = re.search(r"(#[^\s,:]+)", rest)[1]
        if word == "witness_method":
            x = body.fresh(r)
            return [new(x, rest.split(",")[0].strip().removeprefix("$")), s("dynamic_ref", result=r, result_type=t, obj=x, fn_index=f"#{index}")]
        return [s("dynamic_ref", result=r, result_type=t, obj=v[0], fn_index=ref)]
    if word in FOREIGN:
        ref = re.search(r"(#[^\s,:]+)", rest)[1]
        body.builtins[ref] = len(split_types(re.search(r"\((.*)\) ->", t)[1])) if re.search(r"\((.*)\) ->", t) else 0
        return [s("builtin_ref", result=r, result_type=t, fn_name=ref)]
    if word in ("apply", "partial_apply", "begin_apply", "try_apply"):
        m = re.search(r"%\d+", rest)
        inner = rest[m.end() :]
        if inner.startswith("<"):
            depth = 0
            for i, c in enumerate(inner):
                depth += (c == "<") - (c == ">" and inner[i - 1] != "-")
                if depth == 0:
                    inner = inner[i + 1 :]
                    break
        args = body.values(inner[: inner.find(")") + 1])
        kind = rest[rest.find(" : $") + 4 :]
        if word == "try_apply":
            kind = kind[: kind.rfind(", normal ")]
            x, ok = body.fresh(m[0]), body.fresh(m[0])
            normal, error = re.search(r"normal (bb\d+), error (bb\d+)", rest).groups()
            return [
                s("apply", result=x, result_type=result_type(kind), callee_sym=body.value(m[0]), callee_type=kind, args=args),
                new(ok, "Builtin.Int1"),
                s("cond_br", src=ok, targets=[{"label": normal, "args": [x]}, {"label": error, "args": [x]}]),
            ]
        x = r or body.fresh(m[0])
        out = [s("apply", result=x, result_type=result_type(kind), callee_sym=body.value(m[0]), callee_type=kind, args=args)]
        return out + [new(more, "Any") for more in results[1:]]
    if word == "builtin":
        name, kind = _TEXT.search(rest)[1], t
        given = rest[rest.find("(") : rest.rfind(")") + 1]
        body.builtins[name] = len(body.values(given))
        x = body.fresh(r)
        return [s("builtin_ref", result=x, result_type="Any", fn_name=name), s("apply", result=r, result_type=kind, callee_sym=x, args=body.values(given))]
    if word == "tuple":
        out = [new(r, t if t != "Any" else "()")]
        return out + [s("field_write", src=x, obj=r, field=str(i)) for i, x in enumerate(v)]
    if word in ("tuple_extract", "struct_extract", "unchecked_enum_data"):
        name = "data" if word == "unchecked_enum_data" else re.search(r"#[\w.]*?\.?(\w+)(?=$|,|!| )", rest)[1] if "#" in rest else split_types(rest)[-1]
        return [s("field_read", result=r, result_type="Any", obj=v[0], field=name)]
    if word in ("tuple_element_addr", "ref_element_addr", "init_enum_data_addr", "unchecked_take_enum_data_addr"):
        name = "data" if "enum" in word else re.search(r"#[\w.]*?\.?(\w+)(?=$|,|!| )", rest)[1] if "#" in rest else split_types(rest)[-1]
        x = body.fresh(r)
        return [new(r, "*Any"), s("field_read", result=x, result_type="Any", obj=v[0], field=name, assign_tag=r), s("pointer_write", src=x, obj=r)]
    if word == "struct_element_addr":
        name = re.search(r"#[\w.]*?\.?(\w+)(?=$|,|!| )", rest)[1]
        x, y = body.fresh(r), body.fresh(r)
        return [
            new(r, "*Any"),
            s("pointer_read", result=x, result_type=pointee(t), obj=v[0]),
            s("field_read", result=y, result_type="Any", obj=x, field=name, assign_tag=r),
            s("pointer_write", src=y, obj=r),
        ]
    if word == "destructure_tuple":
        return [s("field_read", result=x, result_type="Any", obj=v[0], field=str(i)) for i, x in enumerate(results)]
    if word == "destructure_struct":
        fields = STRUCT_FIELDS.get(t.split(".")[-1])
        if fields and len(fields) == len(results):
            return [s("field_read", result=x, result_type="Any", obj=v[0], field=f) for x, f in zip(results, fields)]
        return [s("assign", result=x, result_type="Any", src=v[0]) for x in results]
    if word == "struct":
        kind = rest[: rest.find(" (")].removeprefix("$")
        out = [new(r, kind)]
        fields = STRUCT_FIELDS.get(kind.split(".")[-1]) or [str(i) for i in range(len(v))]
        return out + [s("field_write", src=x, obj=r, field=f) for x, f in zip(v, fields)]
    if word == "enum":
        parts = split_types(rest)
        tag = body.fresh(r)
        out = [new(r, parts[0].removeprefix("$")), s("literal", result=tag, result_type="Builtin.RawPointer", lit_str=parts[1].removeprefix("#")), s("field_write", src=tag, obj=r, field="type")]
        return out + [s("field_write", src=x, obj=r, field="data") for x in v[:1]]
    if word == "inject_enum_addr":
        tag = body.fresh(v[0])
        return [s("literal", result=tag, result_type="Builtin.RawPointer", lit_str=re.search(r"#(\S+)", rest)[1]), s("field_write", src=tag, obj=v[0], field="type")]
    if word in ("select_enum", "select_enum_addr", "select_value"):
        cases = re.findall(r"case (\S+): (%\d+)", rest)
        other = re.search(r"default (%\d+)", rest)
        targets = [{"label": None, "args": [body.value(x)]} for _, x in cases] + ([{"label": None, "args": [body.value(other[1])]}] if other else [])
        src, out = v[0], []
        if word == "select_enum_addr":
            src = body.fresh(v[0])
            out = [s("pointer_read", result=src, result_type="Any", obj=v[0])]
        kind = "switch_value_assign" if word == "select_value" else "switch_enum_assign"
        keys = {"args": [body.value(k) for k, _ in cases]} if word == "select_value" else {"lit_str": "\x1f".join(k.removeprefix("#") for k, _ in cases)}
        return [*out, s(kind, result=r, result_type=t, src=src, targets=targets, fn_index="default" if other else None, **keys)]
    if word == "cond_fail":
        return [s("cond_fail", src=v[0])]
    target = lambda label, args="": {"label": label, "args": body.values(args or "")}
    if word == "unreachable":
        return [s("unreachable")]
    if word in ("return", "throw"):
        return [s("return", src=v[0])]
    if word == "unwind":
        x = body.fresh("unwind")
        return [new(x, "()"), s("return", src=x)]
    if word == "yield":
        given = rest[: rest.find(", resume")]
        resume, unwind = re.search(r"resume (bb\d+), unwind (bb\d+)", rest).groups()
        return [s("yield", args=body.values(given), targets=[target(resume), target(unwind)])]
    if word == "br":
        m = re.match(r"(bb\d+)(\(.*\))?", rest)
        return [s("br", targets=[target(m[1], m[2])])]
    if word == "cond_br":
        m = re.match(r"%\d+, (bb\d+)(\([^)]*\))?, (bb\d+)(\([^)]*\))?", rest)
        return [s("cond_br", src=v[0], targets=[target(m[1], m[2]), target(m[3], m[4])])]
    if word in ("dynamic_method_br", "checked_cast_br", "checked_cast_addr_br"):
        labels = re.findall(r"\bbb\d+", rest)[-2:]
        c = body.fresh(v[0])
        test = s("binary_op", result=c, result_type="Builtin.Int1", field_attr="arb", args=v[:2]) if word == "checked_cast_addr_br" else s("unary_op", result=c, result_type="Builtin.Int1", field_attr="arb", args=v[:1])
        passed = [] if word == "checked_cast_addr_br" else v[:1]
        return [test, s("cond_br", src=c, targets=[{"label": labels[0], "args": passed}, {"label": labels[1], "args": passed if word == "checked_cast_br" else []}])]
    if word in ("switch_enum", "switch_enum_addr"):
        cases, other = re.findall(r"case #(\S+): (bb\d+)", rest), re.search(r"default (bb\d+)", rest)
        src, out = v[0], []
        if word == "switch_enum_addr":
            src = body.fresh(v[0])
            out = [s("pointer_read", result=src, result_type="Any", obj=v[0])]
        targets = [target(b) for _, b in cases] + ([target(other[1])] if other else [])
        return [*out, s("switch_enum", src=src, lit_str="\x1f".join(c for c, _ in cases), targets=targets, fn_index="default" if other else None)]
    if word == "switch_value":
        cases, other = re.findall(r"case (%\d+): (bb\d+)", rest), re.search(r"default (bb\d+)", rest)
        targets = [target(b) for _, b in cases] + ([target(other[1])] if other else [])
        return [s("switch", src=v[0], args=[body.value(c) for c, _ in cases], targets=targets, fn_index="default" if other else None)]
    raise ParseError(f"{body.module}: unknown instruction {word}")


def stub(module: str, name: str, returns: str, args: list[str]) -> Function:
    """A function without body: it returns something new."""
    block = Block("bb0", [(f"%{i}", t) for i, t in enumerate(args)], [stmt("new", result="%ret", result_type=returns, alloc_type=returns), stmt("return", src="%ret")])
    return Function(module, name, "stub", returns, returns, [block])


def parse(text: str, module: str) -> list[Function]:
    """The raw functions of a module, with stubs for what has no body and a main that allocates the globals."""
    return list(each(text, module))


def each(text: str, module: str) -> Iterator[Function]:
    """The functions of `parse`, one after the other."""
    if not re.match(r"\s*sil_stage canonical\b", text):
        raise ParseError(f"{module}: only the canonical stage can be read")
    known, current, body, builtins = set(), None, None, {}
    global_types = re.findall(r"^sil_global [^@]*@(\S+) : \$(.*)$", text, re.M)
    for line in StringIO(text):
        line = line.removesuffix("\n")
        if current is None:
            m = _DEF.match(line)
            if not m:
                continue
            name, kind = m[1], m[2].removeprefix("$").strip()
            name = f"main_{module}" if name == "main" else name
            returns = result_type(kind)
            if not m[3]:
                params = re.match(r"(?:@\S+ )*(?:<[^>]*> )?\((.*)\) ->", kind)
                known.add(name)
                yield stub(module, name, returns, [p for p in split_types(params[1])] if params else [])
                continue
            attribute = "coroutine" if "@yield_once" in kind or "@yield_many" in kind else None
            current, body = Function(module, name, attribute, returns, kind), _Body(module)
            continue
        if line.startswith("}"):
            finish(current, body)
            builtins |= body.builtins
            known.add(current.name)
            yield current
            current = None
            continue
        m = _BLOCK.match(line)
        if m:
            args = [a.partition(" : ") for a in split_types(m[2] or "")]
            current.blocks.append(Block(m[1], [(a.strip(), t.replace("$", "")) for a, _, t in args]))
            continue
        m = _LINE.match(line)
        if not m or not current.blocks:
            continue
        rest = cut_comment(m[3])
        loc = _LOC.search(rest)
        pos = (loc[1], int(loc[2]), int(loc[3])) if loc and loc[2] else None
        rest = re.sub(r", scope \d+\s*$", "", rest)
        rest = _LOC.sub("", rest).strip()
        results = [x.strip() for x in (m[1] or "").strip("()").split(",") if x.strip()]
        current.blocks[-1].stmts += instruction(body, results, m[2], rest, pos)
    added = [(name, n) for name, n in sorted(builtins.items()) if name not in known]
    yield from (stub(module, name, "Any", ["Any"] * n) for name, n in added)
    if f"main_{module}" in known or f"main_{module}" in dict(added):
        yield fake_main(module, global_types)


def cut_comment(rest: str) -> str:
    """A line without the comment at its end; quoted text may hold slashes."""
    quoted = False
    for i, c in enumerate(rest):
        if c == '"' and (i == 0 or rest[i - 1] != "\\"):
            quoted = not quoted
        elif not quoted and rest.startswith("//", i):
            return rest[:i].rstrip()
    return rest.rstrip()


def finish(f: Function, body: _Body) -> None:
    """Give symbols the names that debug information has for them, the first for each."""
    used = set()
    names = {}
    for v, n in body.rename.items():
        if n not in used:
            used.add(n)
            names[body.value(v)] = n
    sub = lambda x: names.get(body.value(x), body.value(x)) if x else x
    for b in f.blocks:
        b.args = [(sub(a), t) for a, t in b.args]
        for s in b.stmts:
            for c in ("result", "src", "obj", "callee_sym"):
                s[c] = sub(s[c])
            if s["kind"] == "field_read" and s["assign_tag"]:
                s["assign_tag"] = sub(s["assign_tag"])
            s["args"] = [sub(a) for a in s["args"]]
            s["targets"] = [{"label": t["label"], "args": [sub(a) for a in t["args"]]} for t in s["targets"]]


def fake_main(module: str, global_types: list[tuple[str, str]]) -> Function:
    """An entry that makes every global and calls the module's main with two new arguments."""
    b = Block("bb0")
    for i, (name, t) in enumerate(global_types):
        b.stmts.append(stmt("new", result=f"g_{i}", result_type=pointer(t), alloc_type=pointer(t)))
        b.stmts.append(stmt("singleton_write", src=f"g_{i}", static_key=f"Globals_{module}.{name}"))
    for i, t in enumerate(("Int32", "UnsafeMutablePointer<Optional<UnsafeMutablePointer<Int8>>>")):
        b.stmts.append(stmt("new", result=f"arg{i}", result_type=t, alloc_type=t))
    b.stmts.append(stmt("function_ref", result="f", result_type="Any", fn_name=f"main_{module}"))
    b.stmts.append(stmt("apply", result="ret", result_type="Int32", callee_sym="f", args=["arg0", "arg1"]))
    b.stmts.append(stmt("return", src="ret"))
    return Function(module, f"entry_{module}", None, "Int32", "Int32", [b])


def tables(text: str) -> dict[str, list[tuple]]:
    """Rows of the dispatch tables: vtable_entry(class, idx, method, declaring), witness(class, protocol),
    witness_entry(class, protocol, idx, method), base(class, protocol); global(name, type)."""
    out: dict[str, list[tuple]] = {"vtable_entry": [], "witness": [], "witness_entry": [], "base": [], "global": []}
    for m in re.finditer(r"^sil_vtable (?:\[[^\]]*\] )*(\S+) \{\n(.*?)^\}", text, re.M | re.S):
        for e in re.finditer(r"^  #(\S+?):? .*?: @(\S+)|^  #(\S+): @(\S+)", m[2], re.M):
            index = (e[1] or e[3]).rstrip(":")
            out["vtable_entry"].append((m[1], f"#{index}", e[2] or e[4], index.split(".")[0]))
    for m in re.finditer(r"^sil_witness_table (?:[a-z_]+ )?(?:\[[^\]]*\] )*(?:<[^>]*> )?(\S+): (\S+) module (\S+)(?: \{\n(.*?)^\})?", text, re.M | re.S):
        out["witness"].append((m[1], m[2]))
        for line in (m[4] or "").split("\n"):
            e = re.match(r"  method #([^\s:]+).*: @(\S+)", line)
            if e:
                out["witness_entry"].append((m[1], m[2], f"#{e[1]}", e[2]))
            e = re.match(r"  base_protocol (\S+):", line)
            if e:
                out["base"].append((m[1], e[1]))
    out["global"] = [(n, t) for n, t in re.findall(r"^sil_global [^@]*@(\S+) : \$(.*)$", text, re.M)]
    return out


TABLES = {
    "vtable_entry": "class string, idx string, method string, declaring string",
    "witness": "class string, protocol string",
    "witness_entry": "class string, protocol string, idx string, method string",
    "base": "class string, protocol string",
    "global": "name string, type string",
}


#: Columns of one parse: what a row is (function or a table's name), a function, or an entry of a table.
PARSED = f"what string, {FUNCTION}, entry array<string>"


def parsed(texts: DataFrame) -> DataFrame:
    """Functions, lowered, and the rows of the dispatch tables of (module, text) rows, told apart by what; each text is parsed once."""

    small_batches(texts.sparkSession)

    def run(batches):
        import pandas as pd

        for batch in batches:
            for module, text in zip(batch.module, batch.text):
                made = ({"what": "function", **canonical(f).row()} for f in each(text or "", module))
                entries = ({"what": name, "module": module, "entry": list(row)} for name, found in tables(text or "").items() for row in found)
                columns = ["what", "module", "func", "attribute", "return_type", "full_type", "blocks", "entry"]
                for some in batched(chain(made, entries), AT_ONCE):
                    yield pd.DataFrame([[r.get(c) for c in columns] for r in some], columns=columns)

    return spread(texts.select("module", "text"), "module", "text").mapInPandas(run, PARSED)


def texts(spark: SparkSession, path: str, glob: str = "*.sil") -> DataFrame:
    """module, text of all compiled modules under a path; Spark lists it, so any shared file system will do."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("module"), F.col("value").alias("text"))


def read(spark: SparkSession, path: str, glob: str = "*.sil") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Nested function rows, lowered, and the dispatch tables of all modules under a path."""
    return split(texts(spark, path, glob))


def split(texts: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Functions and dispatch tables of (module, text) rows: parts of one table that a single parse has written."""
    one = stored(parsed(texts))
    out = {}
    for name, schema in TABLES.items():
        columns = [c.split(" ")[0] for c in schema.split(", ")]
        out[name] = one.where(F.col("what") == name).select("module", *[F.col("entry")[i].alias(c) for i, c in enumerate(columns)])
    return one.where("what = 'function'").drop("what", "entry"), out


def demangled(functions_: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Functions under the names of dictionary(mangled, demangled), in definitions and references."""
    pairs = dictionary.select(F.col("mangled").alias("func"), "demangled")
    out = functions_.join(pairs, "func", "left").withColumn("func", F.coalesce("demangled", "func")).drop("demangled")
    refs = out.select("module", "func", F.explode("blocks").alias("b")).select("module", "func", F.explode("b.stmts").alias("s")).select("module", "func", F.col("s.fn_name").alias("n"))
    used = refs.join(dictionary, refs.n == dictionary.mangled).groupBy("module", "func").agg(F.map_from_entries(F.collect_set(F.struct("mangled", "demangled"))).alias("d"))
    out = out.join(used, ["module", "func"], "left")
    renamed = F.transform(
        "blocks",
        lambda b: b.withField("stmts", F.transform(b["stmts"], lambda s: s.withField("fn_name", F.coalesce(F.try_element_at(F.col("d"), s["fn_name"]), s["fn_name"])))),
    )
    return out.withColumn("blocks", F.when(F.col("d").isNotNull(), renamed).otherwise(F.col("blocks"))).drop("d")
