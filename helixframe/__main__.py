"""python -m helixframe index FASTA --store DIR | align FASTA FASTQ --out DIR [--store DIR] | stats FASTA --out DIR"""

from __future__ import annotations

import argparse

from helixframe.params import AlignParams

#: Command-line letters and the parameters they set.
FLAGS = {"-H": "max_count", "-T": "n_tables", "-b": "proj_len", "-p": "buckets_pow2", "-k": "k", "-w": "w", "-m": "min_hits", "-N": "best_dist", "-v": "k2",
         "-d": "delta", "-x": "delta_x", "-c": "cutoff", "-f": "scale", "-I": "interval", "-B": "bin_size", "-S": "task_size", "-Z": "batch", "-s": "h"}


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    a = argparse.ArgumentParser(prog="helixframe", description=__doc__)
    a.add_argument("command", choices=["index", "align", "stats"])
    a.add_argument("files", nargs="+")
    a.add_argument("--out")
    a.add_argument("--store")
    a.add_argument("-M", dest="mask_neighbours", action="store_true")
    a.add_argument("-V", dest="vanilla", action="store_true")
    for flag, name in FLAGS.items():
        a.add_argument(flag, dest=name, type=int)
    return a.parse_args(argv)


def params(ns: argparse.Namespace) -> AlignParams:
    given = {n: getattr(ns, n) for n in FLAGS.values() if getattr(ns, n) is not None}
    p = AlignParams(**given, mask_neighbours=ns.mask_neighbours)
    return p.vanilla() if ns.vanilla else p


def main(argv: list[str] | None = None) -> None:
    ns = parse(argv)
    p = params(ns)
    from pyspark.sql import SparkSession

    from helixframe.operators import index as ix, kmers as km
    from helixframe.plans import align
    from helixframe.sources import files

    spark = SparkSession.builder.appName("helixframe").getOrCreate()
    if ns.command == "align":
        align.align_files(spark, ns.files[0], ns.files[1], ns.out, p, ns.store)
        return
    refs = files.fasta(spark, ns.files[0])
    hist = hist_of(refs, p)
    if ns.command == "index":
        kept = files.Store(spark, ns.store, p)
        hist = kept.get("kmer_hist", lambda: hist_of(refs, p))
        kept.get("index", lambda: ix.build(refs, hist, p), ["tbl"])
    else:
        km.count_of_counts(hist).write.mode("overwrite").csv(f"{ns.out}/count_of_counts")
        files.write_counts(hist, f"{ns.out}/counts")


def hist_of(refs, p: AlignParams):
    from helixframe.plans import align

    return align.histogram(refs, p)


if __name__ == "__main__":
    main()
