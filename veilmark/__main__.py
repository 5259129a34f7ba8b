"""python -m veilmark"""

import sys

from veilmark.cli import main

sys.exit(main())
