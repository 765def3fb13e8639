"""``python -m leafline``."""

import sys

from leafline.cli import main

sys.exit(main())
