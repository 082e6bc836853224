"""Agents, tools, servers and delegations of Python sources, by their syntax alone: nothing is imported or run.

One Arrow pass parses each file once, and every framework whose module it imports reads the same tree. The pass only
states what stands there, as a tagged union of rows (agent, tool, function, call, server, delegation, diagnostic) with a JSON
detail; what it means (capabilities, approvals, sandboxes, authentication) is worked out in DataFrame expressions.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantscope.functions import expr as X
from grantscope.operators import flows

SCHEMA = "path string, kind string, framework string, owner string, name string, line int, detail string"
# What calls build an agent in each framework, and which argument hands over to others.
FRAMEWORKS = {
    "google-adk": ("google.adk", ("Agent", "LlmAgent", "SequentialAgent", "ParallelAgent", "LoopAgent", "Workflow", "RemoteA2aAgent"), "sub_agents"),
    "openai-agents": ("agents", ("Agent",), "handoffs"),
    "pydantic-ai": ("pydantic_ai", ("Agent",), None),
    "langgraph": ("langgraph", ("create_react_agent", "create_agent"), None),
    "fast-agent": ("mcp_agent", ("FastAgent",), None),
    "langchain": ("langchain_core", (), None),
    "mcp-python": ("mcp", ("FastMCP", "Server"), None),
}
TOOL_DECORATORS = ("function_tool", "tool", "tool_plain")
SERVER_CALLS = {
    "MCPServerStdio": "stdio", "MCPServerSse": "sse", "MCPServerSSE": "sse", "MCPServerStreamableHttp": "streamable-http", "MCPServerStreamableHTTP": "streamable-http", "MCPToolset": "unknown", "McpToolset": "unknown",
    "StdioConnectionParams": "stdio", "StdioServerParameters": "stdio", "SseConnectionParams": "sse", "StreamableHTTPConnectionParams": "streamable-http", "MultiServerMCPClient": "unknown",
}
# Tools that frameworks bring along, and their capabilities.
_WEB, _RW = "data.read,network.external", "data.read,data.write,network.external"
_ALL = "data.read,data.write,external.write,network.external"
BUILTIN_TOOLS = {
    "ExecuteBashTool": "process.execute," + _RW, "EnvironmentToolset": "process.execute,data.read,data.write", "ComputerUseToolset": "computer.control," + _ALL, "GoogleSearchTool": _WEB, "google_search": _WEB, "UrlContextTool": _WEB,
    "url_context": _WEB, "load_web_page": _WEB, "DiscoveryEngineSearchTool": _WEB, "VertexAiSearchTool": _WEB, "VertexAiRagRetrieval": _WEB, "EnterpriseWebSearchTool": _WEB, "BigQueryToolset": _RW, "BigtableToolset": _RW, "DataAgentToolset": _RW,
    "GmailToolset": _ALL, "CalendarToolset": _ALL, "DocsToolset": _RW, "SheetsToolset": _RW, "SlidesToolset": _RW, "YoutubeToolset": _ALL, "GoogleApiToolset": _ALL, "APIHubToolset": _ALL, "ApplicationIntegrationToolset": _ALL, "OpenAPIToolset": _ALL,
    "RestApiTool": _ALL, "LoadMemoryTool": "data.read", "load_memory": "data.read", "LoadArtifactsTool": "data.read", "load_artifacts_tool": "data.read", "load_artifacts": "data.read", "LoadMcpResourceTool": "data.read,mcp.remote", "TransferToAgentTool": "agent.delegate",
    "WebSearchTool": _WEB, "XSearchTool": _WEB, "WebFetchTool": _WEB, "CodeExecutionTool": "process.execute,data.read,data.write", "CodeInterpreterTool": "process.execute,data.read,data.write", "ImageGenerationTool": "external.write,network.external",
    "MemoryTool": "data.read,data.write", "FileSearchTool": "data.read", "ComputerTool": "computer.control", "ShellTool": "process.execute", "LocalShellTool": "process.execute", "ApplyPatchTool": "data.write",
}
CODE_EXECUTORS = {"UnsafeLocalCodeExecutor": False, "BuiltInCodeExecutor": True, "AgentEngineSandboxCodeExecutor": True, "GkeCodeExecutor": True}
#: First words of helpers that check rather than act, and what their names alone don't make them do.
CONTROL_PREFIXES = ("approve", "check", "confirm", "validate", "verify")
CONTROL_CAPS = ("process.execute", "destructive.write", "external.write", "data.write", "secrets.read", "identity.admin", "network.external")
CONFIRMERS = ("input", "confirm", "interrupt", "request_confirmation", "ask_user")


def _last(node) -> str:
    node = node.value if isinstance(node, ast.Subscript) else node
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""


def _dotted(node) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ".".join(reversed(parts))


def _plain(node):
    """A literal's value; a call as {"call": name, its keywords}; a name as {"name": it}; else None."""
    try:
        return ast.literal_eval(node)
    except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
        pass
    if isinstance(node, ast.Call):
        return {"call": _last(node.func), **{k.arg: _plain(k.value) for k in node.keywords if k.arg}}
    if isinstance(node, (ast.List, ast.Tuple)):
        return [_plain(x) for x in node.elts]
    if isinstance(node, ast.Dict):
        return {str(k.value): _plain(v) for k, v in zip(node.keys, node.values) if isinstance(k, ast.Constant)}
    return {"name": _dotted(node)} if isinstance(node, (ast.Name, ast.Attribute)) else None


def _modules(tree) -> set[str]:
    names = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            names |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            names.add(node.module)
    return names


def scan(path: str, source: str | None):
    """Rows of one file."""
    if source is None:
        return
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        yield (path, "diagnostic", None, None, "parse_error", getattr(e, "lineno", None) or 1, type(e).__name__)
        return
    modules = _modules(tree)
    read = [f for f, (module, *_) in FRAMEWORKS.items() if any(m == module or m.startswith(module + ".") for m in modules)]
    if read:
        yield from _functions(path, tree, read[0])
    for framework in read:
        yield from _agents(path, tree, framework)


def _functions(path, tree, framework):
    """Every function with its decorators and calls; calls of nested functions count for the outer one too."""
    for node in ast.walk(tree):
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        marks = {_last(m.func if isinstance(m, ast.Call) else m): _plain(m) if isinstance(m, ast.Call) else {} for m in node.decorator_list}
        calls = [c for c in ast.walk(node) if isinstance(c, ast.Call) and not any(c is d or c in ast.walk(d) for d in node.decorator_list)]
        mark = next((m for m in TOOL_DECORATORS if m in marks), None)
        given = marks.get(mark) or {}
        asked = any(_last(c.func) in CONFIRMERS for c in calls)
        detail = {"decorator": mark, "needs_approval": given.get("needs_approval", given.get("requires_approval")), "asks": asked, "params": [a.arg for a in node.args.args]}
        yield (path, "function", framework, None, node.name, node.lineno, json.dumps(detail, default=str))
        for c in calls:
            first = _plain(c.args[0]) if c.args else None
            mode = _plain(c.args[1]) if len(c.args) > 1 else next((_plain(k.value) for k in c.keywords if k.arg == "mode"), None)
            yield (path, "call", framework, node.name, _dotted(c.func) or _last(c.func), c.lineno, json.dumps({"first": first, "mode": mode}, default=str))


def _agents(path, tree, framework):
    _, makers, hand_over = FRAMEWORKS[framework]
    built, variables = [], {}
    for node in ast.walk(tree):
        if isinstance(node, (ast.Assign, ast.AnnAssign)) and isinstance(node.value, ast.Call) and _last(node.value.func) in makers:
            built.append((node.value, _last(node.targets[0] if isinstance(node, ast.Assign) else node.target)))
        elif isinstance(node, (ast.Return, ast.Expr)) and isinstance(node.value, ast.Call) and _last(node.value.func) in makers:
            built.append((node.value, ""))
    values = {_last(n.targets[0]): _plain(n.value) for n in ast.walk(tree) if isinstance(n, ast.Assign)}
    for call, variable in built:
        given = {k.arg: k.value for k in call.keywords if k.arg}
        first = call.args[0].value if call.args and isinstance(call.args[0], ast.Constant) and framework != "langgraph" else None
        name = _plain(given["name"]) if isinstance(given.get("name"), ast.Constant) else first or variable or "unnamed-agent"
        variables[variable] = name
    for call, variable in built:
        given = {k.arg: k.value for k in call.keywords if k.arg}
        name = variables[variable]
        detail = {k: _plain(given[k]) for k in ("before_tool_callback", "plugins", "code_executor", "agent_card", "auth_scheme", "auth_credential", "model") if k in given}
        yield (path, "agent", framework, None, name, call.lineno, json.dumps({"class": _last(call.func), **detail}, default=str))
        tools = given.get("tools", call.args[1] if framework == "langgraph" and len(call.args) > 1 else None)
        if isinstance(tools, ast.Name) and isinstance(values.get(tools.id), list):
            items, at = values[tools.id], [tools.lineno] * len(values[tools.id])
        elif isinstance(tools, (ast.List, ast.Tuple)):
            items, at = [_plain(t) for t in tools.elts], [t.lineno for t in tools.elts]
        else:
            items, at = [], []
            if tools is not None:
                yield (path, "diagnostic", framework, name, "unresolved_tool", tools.lineno, "dynamic_tools")
        for t, line in zip(items, at):
            t = values.get(t["name"], t) if isinstance(t, dict) and set(t) == {"name"} and isinstance(values.get(t["name"]), dict) else t
            known = t if isinstance(t, dict) else {}
            called = known.get("call")
            if called in SERVER_CALLS:
                yield (path, "server", framework, name, str(known.get("name") or called), line, json.dumps(known, default=str))
            else:
                yield (path, "tool", framework, name, called or (known.get("name") or "").split(".")[-1] or "<dynamic>", line, json.dumps(known, default=str))
        servers = _plain(given["mcp_servers"]) if "mcp_servers" in given else _plain(given["toolsets"]) if "toolsets" in given else []
        for server in servers if isinstance(servers, list) else []:
            server = values.get(server.get("name"), server) if isinstance(server, dict) and "call" not in server else server
            if isinstance(server, dict):
                yield (path, "server", framework, name, str(server.get("name") or server.get("call") or "<dynamic>"), call.lineno, json.dumps(server, default=str))
        others = given.get(hand_over) if hand_over else None
        for other in getattr(others, "elts", ()):
            yield (path, "delegation", framework, name, variables.get(_last(other), _last(other)), other.lineno, "")


def _scan(frames):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for f in frames:
        yield pd.DataFrame([row for p, t in zip(f["path"], f["text"]) for row in scan(p, t)], columns=names).astype({"line": "int32"})


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of `files` (path, text); files without text pass unread, as their own diagnostics say."""
    return files.select("path", "text").mapInPandas(_scan, SCHEMA)


def notebook_text(files: DataFrame) -> DataFrame:
    """(path, text) of notebooks: their code cells in order, magics and shell lines replaced by pass."""
    cells = F.from_json("text", "struct<cells:array<struct<cell_type:string,source:string>>>")["cells"]
    # a cell's source is a string or a JSON array of lines
    lines = lambda s: F.coalesce(F.array_join(F.from_json(s, "array<string>"), ""), s)
    code = F.transform(F.filter(cells, lambda c: c["cell_type"] == "code"), lambda c: F.regexp_replace(lines(c["source"]), r"(?m)^(\s*)[%!].*$", "$1pass"))
    return files.select("path", F.array_join(code, "\n").alias("text"))


def approval(value: Column) -> Column:
    """A JSON approval setting as true, false or unknown: booleans, always and never, or a mapping that agrees."""
    plain = F.lower(F.trim(value))
    each = F.map_values(F.from_json(value, "map<string,string>"))
    all_ = lambda *words: (F.size(each) > 0) & F.forall(each, lambda v: F.lower(v).isin(*words))
    return F.when(plain.isin("true", "always") | all_("true", "always"), True).when(plain.isin("false", "never") | all_("false", "never"), False)


def call_capabilities(called: Column, first: Column, mode: Column) -> Column:
    """Capabilities that one call shows, by what it is rather than by what it is named."""
    name, leaf = F.lower(called), F.element_at(F.split(F.lower(called), r"\."), -1)
    sink, source = flows.sink_kind(called), flows.source_kind(called)
    tests = [
        ("process.execute", sink == "process_execute"), ("external.write", sink == "external_send"), ("network.external", (sink == "external_send") | source.isin("external_http_response", "web_retrieval", "mcp_response")),
        ("secrets.read", source == "secret_value"), ("data.write", (sink == "memory_write") | ((leaf == "open") & F.coalesce(mode, F.lit("")).rlike("[wax+]")) | leaf.isin("write_text", "write_bytes")),
        ("data.read", ((leaf == "open") & ~F.coalesce(mode, F.lit("")).rlike("[wax]")) | leaf.isin("read_text", "read_bytes")), ("destructive.write", name.isin("os.remove", "os.unlink", "os.rmdir", "shutil.rmtree") | leaf.isin("unlink", "rmtree")),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(c)) for c, t in tests]))


def without_control_names(name: Column, by_name: Column, by_body: Column) -> Column:
    """Capabilities of a decorated tool: a helper that checks gets those of its name only where its body bears them out."""
    helper = F.element_at(F.split(F.lower(F.replace(name, F.lit("-"), F.lit("_"))), "_"), 1).isin(*CONTROL_PREFIXES)
    loose = F.array_except(F.array_intersect(by_name, X.strings(CONTROL_CAPS)), by_body)
    return X.sorted_set(F.when(helper, F.array_except(by_name, loose)).otherwise(F.array_union(by_name, by_body)))
