import sys

from granary.cli import main

sys.exit(main())
