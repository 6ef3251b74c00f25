import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import awkward, given, nothing  # noqa: E402, F401
