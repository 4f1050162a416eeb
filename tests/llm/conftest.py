import os
import sys
from pathlib import Path

# Tasks import the helpers of these tests, too.
HERE = str(Path(__file__).resolve().parent)
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, str(Path(HERE).parents[1]), os.environ.get("PYTHONPATH")]))
