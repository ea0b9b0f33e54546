"""Command line: ``python -m voxloom PATH... [options]``, ``python -m voxloom models list|pull|remove|path``."""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from .errors import CODES, EngineError
from .options import FORMATS, JobOptions


def _load(name: str | None, stand_in):
    """An object from ``module:name``, called if it can be; the stand-in where none is named."""
    if name is None:
        return stand_in()
    module, _, attribute = name.partition(":")
    made = getattr(importlib.import_module(module), attribute)
    return made() if callable(made) else made


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="voxloom")
    p.add_argument("inputs", nargs="+", help="files and folders, or: models list|pull|remove|path [NAME]")
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--model")
    p.add_argument("--lang", dest="language", default="auto")
    p.add_argument("--task", default="transcribe", choices=("transcribe", "translate"))
    p.add_argument("--format", dest="formats", default="txt", help="comma-separated, of " + ", ".join(FORMATS))
    p.add_argument("--out-dir")
    p.add_argument("--jobs", type=int)
    p.add_argument("--threads", type=int)
    p.add_argument("--force", action="store_true")
    p.add_argument("--dry-run", dest="explain_only", action="store_true")
    p.add_argument("--decoder", default="builtin", choices=("builtin", "ffmpeg"))
    p.add_argument("--json", action="store_true")
    p.add_argument("--offline", action="store_true")
    p.add_argument("--diarize", action="store_true")
    p.add_argument("--speakers", dest="num_speakers", type=int)
    p.add_argument("--transcriber", help="module:name of a transcriber; without one a stand-in runs that recognises nothing")
    p.add_argument("--speaker-models", help="module:name of speaker models")
    p.add_argument("--fetch", help="module:name of a function (model, path) that gets a model file; models pull needs it")
    p.add_argument("--cache", default=os.path.expanduser("~/.cache/voxloom"), help="folder of models")
    return p


def _models(args) -> int:
    from .plans.resources import human
    from .sources.models import DIARIZATION, ModelCache

    fetch = None
    if args.fetch:
        module, _, attribute = args.fetch.partition(":")
        fetch = getattr(importlib.import_module(module), attribute)
    cache = ModelCache(args.cache, fetch, offline=args.offline)
    pair = lambda names: [m for n in names for m in ([d[0] for d in DIARIZATION] if n == "diarization" else [n])]
    what, *names = args.inputs[1:] or ["list"]
    if what == "list":
        for m in [*cache.listing(), cache.diarization()]:
            print(f"{m['model']:20} {human(m['size']):>10}  {'cached' if m['cached'] else '-'}")
    elif what == "path":
        print(*[cache.path(n) for n in pair(names)] or [cache.folder], sep="\n")
    elif what == "pull":
        for n in pair(names):
            print(cache.ensure(n))
    elif what == "remove":
        for n in pair(names):
            print(f"{n}: {'removed' if cache.evict(n) else 'not cached'}")
    else:
        raise EngineError("usage", detail=f"unknown command models {what}")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.inputs[0] == "models" and not os.path.exists("models"):
            return _models(args)
        own = {"transcriber", "speaker_models", "cache", "fetch"}
        options = JobOptions(**{k: v for k, v in vars(args).items() if k not in own} | {"inputs": tuple(args.inputs), "formats": tuple(args.formats.split(","))})
        return _run(args, options)
    except EngineError as e:
        print(e, file=sys.stderr)
        return e.code


def _run(args, options: JobOptions) -> int:
    from .plans.models import StubSpeakers, StubTranscriber
    from .plans.resources import detected_parallelism, thread_settings
    from .plans.transcribe import plan, run
    from .session import interruptible, local_session

    steps = plan(options)
    if not steps["paths"]:
        print("no audio files", file=sys.stderr)
        return 0
    spark = local_session(**thread_settings(options.threads, detected_parallelism()))
    spark.sparkContext.setLogLevel("ERROR")
    with interruptible(spark) as state:
        try:
            return _report(run(spark, options, _load(args.transcriber, StubTranscriber), _load(args.speaker_models, StubSpeakers)), options)
        except Exception:  # a stopped action fails
            if not state["interrupted"]:
                raise
    total, fresh = len(steps["paths"]), sum(_written(p, options) for p in steps["paths"])
    print(f"{fresh} of {total} with outputs, interrupted", file=sys.stderr)
    if fresh < total:
        raise EngineError("interrupted", completed=fresh, total=total)
    return 0


def _written(path: str, options: JobOptions) -> bool:
    """All outputs of an input are there and no older than it."""
    stem, folder = os.path.splitext(os.path.basename(path))[0], options.out_dir or os.path.dirname(path)
    outputs = [os.path.join(folder, f"{stem}.{f}") for f in options.effective_formats]
    return all(os.path.exists(o) and os.path.getmtime(o) >= os.path.getmtime(path) for o in outputs)


def _report(results, options: JobOptions) -> int:
    from .operators import batch

    if options.explain_only:
        for r in results.orderBy("path", "format").collect():  # one line for each file and format
            print(f"{r['path']} -> {r['output']}")
        return 0
    results = results.cache()
    for r in batch.report_lines(results).orderBy("name").collect():
        print(f"  {r['line']:60} {r['name']}", file=sys.stderr)
    s = batch.summary(results).first()
    print(f"{s['done']} done, {s['skipped']} skipped, {s['failed']} failed{', ' + s['speed'] if s['speed'] else ''}", file=sys.stderr)
    if options.json and s["done"] == 1 and results.count() == 1:
        with open(results.first()["outputs"][0]) as f:
            print(f.read())
    return CODES["partial_batch_failure"] if s["failed"] else 0


if __name__ == "__main__":
    sys.exit(main())
