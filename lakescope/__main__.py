import sys

from lakescope.plans.cli import main

sys.exit(main())
