"""A small repository as files, and the queries that scan it from text to findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantscope.operators import rules
from grantscope.plans.catalog import register
from grantscope.sources import assemble

FILES = [
    ("app/openai_agents.py", '''
import subprocess, requests
from agents import Agent, function_tool
from agents.mcp import MCPServerStdio, MCPServerStreamableHttp

@function_tool
def run_shell(command):
    return subprocess.run(command)

@function_tool
def drop_rows(table):
    if input("sure?") != "yes":
        return
    shutil.rmtree(table)

@function_tool
def verify_delete(row):
    return row is None

@function_tool(needs_approval=True)
def send_note(text):
    requests.post("https://notes.example.com", json=text)

@function_tool
def loose_exec(code):
    exec(code)

docs = MCPServerStreamableHttp(name="docs", params={"url": "http://tools.example.com/mcp"})
files = MCPServerStdio(name="files", params={"command": "npx", "args": ["-y", "server"]}, tool_filter=["read"])
helper = Agent(name="helper", tools=[send_note], mcp_servers=[files])
runner = Agent(name="runner", tools=[run_shell, drop_rows, verify_delete], mcp_servers=[docs], handoffs=[helper])

def main():
    subprocess.run(input("what? "))
'''),
    ("app/adk_agents.py", '''
from google.adk.agents import LlmAgent, RemoteA2aAgent
from google.adk.code_executors import UnsafeLocalCodeExecutor
from google.adk.tools import ExecuteBashTool, google_search

builder = LlmAgent(name="builder", tools=[ExecuteBashTool(), google_search], code_executor=UnsafeLocalCodeExecutor())
far = RemoteA2aAgent(name="far", agent_card="http://card.example.com/agent.json")
'''),
    ("app/graph.py", '''
from langgraph.prebuilt import create_react_agent
graph = create_react_agent(model, load_tools(), name="graph")
'''),
    ("app/broken.py", "from agents import Agent\ndef (:\n"),
    ("mcp.json", '{"mcpServers": {"spare": {"url": "https://spare.example.com", "headers": {"Authorization": "x"}}}}'),
    ("agents.yaml", '''
version: 1
agent:
  name: clerk
  identities: [{name: sa, provider: gcp, roles: [roles/owner]}]
  tools: [{name: shell, capabilities: [process.execute], approval: true}]
  policy: {denied_capabilities: [process.execute]}
'''),
]


@register("repository_findings")
def repository_findings(spark, sf_dir):
    """Findings of the small repository; the supplied tables take no part in it."""
    fs, _ = assemble.repository(spark.createDataFrame(FILES, "path string, text string"))
    return rules.evaluate(fs).withColumn("owasp", F.array_join("owasp", ","))
