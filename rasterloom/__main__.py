import sys

from rasterloom.plans.cli import main

sys.exit(main())
