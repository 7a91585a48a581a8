"""Command line: python -m weft.cli [-o dir] [-q] [-valueflow] [-h] graph method."""

from __future__ import annotations

import sys

from weft.plans.languages import METHODS

_USAGE = f"""usage: python -m weft.cli [-o dir] [-q] [-valueflow] [-h] <graph> <method>
methods: {", ".join(m for m in METHODS if m != "default")}, parityD, on-demand
-o dir      folder of the report (default: output)
-q          counts only, no pairs
-valueflow  keep paths from a store to the load of the same id"""


def parse(argv: list[str]) -> dict:
    """Options and the method behind a name; ValueError says what is wrong."""
    out = {"graph": None, "method": None, "dir": None, "quiet": False, "valueflow": False, "on_demand": False, "parity_d": False, "help": False}
    todo = list(argv)
    while todo:
        arg = todo.pop(0)
        if arg == "-h":
            return out | {"help": True}
        if arg == "-o":
            if not todo:
                raise ValueError("-o needs a folder")
            out["dir"] = todo.pop(0)
        elif arg in ("-q", "-valueflow"):
            out["quiet" if arg == "-q" else "valueflow"] = True
        elif out["graph"] is None:
            out["graph"] = arg
        elif out["method"] is None:
            out["method"] = arg
        else:
            raise ValueError(f"one argument too many: {arg}")
    if out["graph"] is None or out["method"] is None:
        raise ValueError("a graph file and a method are needed")
    if out["method"] == "parityD":
        out |= {"method": "parity", "parity_d": True}
    elif out["method"] == "on-demand":
        out |= {"method": "all", "on_demand": True}
    if out["method"] not in METHODS:
        raise ValueError(f"no method is called {out['method']}")
    return out


def report(spark, options: dict) -> list[str]:
    """The lines of the report: counts, then pairs unless quiet."""
    from weft.plans import analyses
    from weft.session import materialise
    from weft.sources.edge_list import pair_lines, read_edges

    edges = materialise(read_edges(spark, options["graph"]))
    if options["valueflow"]:
        edges = materialise(analyses.value_flow_edges(edges))
    under = materialise(analyses.under_approximation(edges, options["valueflow"], "auto"))
    over = materialise(analyses.over_approximation(edges, options["method"], under, options["valueflow"], "auto"))
    lines = [f"Under approximation paths: {under.count()}", "", f"Over approximation paths ({options['method']}): {over.count()}"]
    shown = over
    if options["on_demand"] or options["parity_d"]:
        shown = materialise(analyses.on_demand(edges, under, over, options["parity_d"], options["valueflow"]))
        lines += ["", f"On-Demand paths ({'parityD' if options['parity_d'] else 'on-demand'}): {shown.count()}"]
    if not options["quiet"]:
        lines += [row["value"] for row in pair_lines(shown).toLocalIterator()]
    return lines


def main(argv: list[str]) -> int:
    try:
        options = parse(argv)
    except ValueError as e:
        print(f"error: {e}\n{_USAGE}", file=sys.stderr)
        return 1
    if options["help"]:
        print(_USAGE)
        return 0
    from weft.session import local_session
    from weft.sources.edge_list import output_path

    path = output_path(options["graph"], options["dir"])
    lines = report(local_session(), options)
    with open(path, "w") as out:
        out.write("\n".join(lines) + "\n")
    print(f"results are in {path}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
