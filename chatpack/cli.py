"""Command line: ``python -m chatpack.cli compile ...`` and ``... index ...``, also by spark-submit."""

from __future__ import annotations

import argparse
import json

from chatpack.functions.plugins import token_measure
from chatpack.operators.index import build_chunk_index, char_measure, rendered
from chatpack.session import session
from chatpack.sources.dataset import compile_jsonl


def tokenizer(path: str):
    """Makes the encoder of a tokenizer file, on the executor that uses it."""

    def make():
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return lambda text: own.encode(text, add_special_tokens=False).ids

    return make


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="chatpack")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("compile", help="JSON Lines to a payload dataset")
    two = commands.add_parser("index", help="a payload dataset to a chunk index")
    for p in (one, two):
        p.add_argument("source")
        p.add_argument("out")
        p.add_argument("--overwrite", action="store_true")
    one.add_argument("--messages-per-record", type=int, default=128)
    one.add_argument("--records-per-shard", type=int, default=10_000)
    two.add_argument("--max-length", type=int, required=True)
    two.add_argument("--records-per-shard", type=int, default=100_000)
    two.add_argument("--tokenizer", help="a tokenizer file (JSON of the tokenizers library) on every executor; measures tokens, not characters")
    two.add_argument("--profile", action="append", default=[], metavar="NAME=VALUE", help="an entry of the index's profile_metadata")
    args = parser.parse_args(argv)
    spark = session()
    if args.command == "compile":
        doc = compile_jsonl(spark, args.source, args.out, args.messages_per_record, args.records_per_shard, args.overwrite)
    else:
        if bad := [p for p in args.profile if "=" not in p]:
            parser.error(f"--profile takes NAME=VALUE, not {bad[0]}")
        profile = dict(p.split("=", 1) for p in args.profile) | ({"tokenizer": args.tokenizer} if args.tokenizer else {})
        measure = token_measure(tokenizer(args.tokenizer), rendered) if args.tokenizer else char_measure
        doc = build_chunk_index(spark, args.source, args.out, args.max_length, measure, args.records_per_shard, args.overwrite, profile)
    print(json.dumps(doc, sort_keys=True))


if __name__ == "__main__":
    main()
