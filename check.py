"""Run registered queries next to their SQL twins: ``python check.py [folder] [name ...]``."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "tests"))

from compare import connect, differences  # noqa: E402

from riskloom.catalog import REGISTRY  # noqa: E402
from riskloom.session import local_session  # noqa: E402


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark, con = local_session(8), connect(folder)
    failed = []
    for name, q in REGISTRY.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            df = q.run(spark, folder)
            if q.sql is None:
                bad, note = [], f"{df.count()} rows, no SQL twin"
            else:
                bad, note = differences(df, con, q.sql), ""
        except Exception as e:
            bad, note = [f"{type(e).__name__}: {str(e).splitlines()[0][:600]}"], ""
            if names:
                traceback.print_exc()
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
        for b in bad[:3]:
            print("     ", b[:1200], flush=True)
        if bad:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
