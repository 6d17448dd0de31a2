import sys

from pulseboard.cli import main

sys.exit(main())
