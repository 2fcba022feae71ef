"""The command line."""

import sys

from pipegrid.sources.commands import main

if __name__ == "__main__":
    sys.exit(main())
