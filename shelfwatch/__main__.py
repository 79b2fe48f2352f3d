import sys

from shelfwatch.plans.run import main

sys.exit(main())
