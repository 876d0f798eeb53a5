"""Command line: python -m meshwork JOB --option value ..."""

from __future__ import annotations

import argparse
import inspect

from .plans import jobs
from .session import job_session

JOBS = {
    "inspect": jobs.inspect,
    "prepare": jobs.prepare_dataset,
    "build-graphs": jobs.build_graphs,
    "build-budget-graphs": jobs.build_budget_graphs,
    "train": jobs.train,
    "analyse": jobs.analyse,
    "check-processed": jobs.check_processed,
    "check-graphs": jobs.check_graphs,
}


def parser() -> argparse.ArgumentParser:
    """A subcommand a job, an option an argument, with the job's own defaults."""
    out = argparse.ArgumentParser(prog="meshwork")
    subs = out.add_subparsers(dest="job", required=True)
    for name, job in JOBS.items():
        sub = subs.add_parser(name, help=(job.__doc__ or name).splitlines()[0])
        for p in list(inspect.signature(job).parameters.values())[1:]:
            option = f"--{p.name.replace('_', '-')}"
            if p.default is p.empty:
                sub.add_argument(option, required=True, nargs="+" if p.name == "paths" else None)
            elif isinstance(p.default, bool):
                off = "--no-" + option.removeprefix("--")
                sub.add_argument(off if p.default else option, dest=p.name, action="store_false" if p.default else "store_true")
            elif isinstance(p.default, tuple):
                sub.add_argument(option, nargs="+", type=int, default=p.default)
            else:
                sub.add_argument(option, default=p.default, type=int if "int" in str(p.annotation) else float if "float" in str(p.annotation) else str)
    return out


def main() -> None:
    options = vars(parser().parse_args())
    job = options.pop("job")
    found = JOBS[job](job_session(), **options)
    print(found) if not hasattr(found, "show") else found.show(100, truncate=False)


if __name__ == "__main__":
    main()
