"""Academic vocabulary and limits: one preset for the otherwise generic operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. They must be exactly these for results to be right.
# ---------------------------------------------------------------------------

# Canonical field -> accepted header spellings, in order of preference.
ACADEMIC_SPELLINGS: dict[str, list[str]] = {
    "student_id": ["student_id", "student id", "id", "roll number", "usn", "rollno", "roll_no"],
    "student_name": ["student_name", "student name", "name", "full name", "fullname"],
    "department": ["department", "dept", "branch", "stream"],
    "semester": ["semester", "sem", "term"],
    "academic_year": ["academic_year", "academic year", "year", "batch"],
    "subject": ["subject", "subject name", "course", "course name", "subject_name", "course_name"],
    "attendance": ["attendance", "attendance %", "attendance percentage", "attendance_pct",
                   "attendance_percentage", "attendance_val"],
    "internal_1": ["internal_1", "internal 1", "internal i", "internal1", "internal_one", "int_1", "int1"],
    "internal_2": ["internal_2", "internal 2", "internal ii", "internal2", "internal_two", "int_2", "int2"],
    "assignment_score": ["assignment_score", "assignment score", "assignment marks", "assignment",
                         "assignments"],
    "quiz_score": ["quiz_score", "quiz score", "quiz marks", "quiz", "quizzes"],
    "final_exam": ["final_exam", "final exam", "final exam score", "final marks", "exam score",
                   "final_exam_score", "finalexam"],
    "previous_gpa": ["previous_gpa", "previous gpa", "prev gpa", "prev_gpa", "last gpa", "cgpa"],
    "study_hours": ["study_hours", "study hours", "study hours/week", "study_hours_week",
                    "study hours per week"],
    "lms_activity": ["lms_activity", "lms activity", "lms logins", "portal logins", "lms_logins",
                     "lms activity score"],
    "assignment_completion": ["assignment_completion", "assignment completion", "assignment completion %",
                              "assignment_completion_pct", "assignments completed"],
}

TEXT_FIELDS = ["student_id", "student_name", "department", "academic_year", "subject"]
NUMERIC_FIELDS = ["attendance", "internal_1", "internal_2", "assignment_score", "quiz_score",
                  "final_exam", "previous_gpa", "study_hours", "lms_activity", "assignment_completion"]
DERIVED_FIELDS = ["performance_index", "current_gpa", "performance_change", "performance_trend"]

# Relative weights of the four parts of the performance index.
INDEX_WEIGHTS = {"internal": 0.30, "assignment": 0.20, "quiz": 0.10, "final_exam": 0.40}

# Change in score beyond which a trend is not STABLE.
TREND_MARGIN = 0.3

PASS_MARK = 40.0
SQL_PASS_MARK = 50.0

# Attendance bands: (lower bound, label); below the last bound -> BAND_DEFAULT.
ATTENDANCE_BANDS = [(90.0, "90% - 100%"), (75.0, "75% - 89%"), (60.0, "60% - 74%")]
BAND_DEFAULT = "Below 60%"
ATTENDANCE_BANDS_LONG = [(90.0, "90% - 100% (Excellent)"), (75.0, "75% - 89% (Good/Required)"),
                         (60.0, "60% - 74% (Shortage/Warning)")]
BAND_DEFAULT_LONG = "Below 60% (Critical Risk)"

# Candidate columns, in order.
CLUSTER_FEATURES = ["current_gpa", "attendance", "study_hours", "assignment_completion", "quiz_score",
                    "final_exam", "lms_activity"]
RISK_FEATURES = ["attendance", "study_hours", "lms_activity", "assignment_completion", "quiz_score",
                 "final_exam", "previous_gpa"]
CORRELATION_TESTS = [("attendance", "Attendance vs GPA"), ("study_hours", "Study Hours vs GPA"),
                     ("lms_activity", "LMS Activity vs GPA"),
                     ("assignment_completion", "Assignment Completion vs GPA")]
GROUP_MEASURES = ["current_gpa", "attendance", "study_hours", "lms_activity"]
POINT_COLUMNS = ["student_id", "student_name", "department", "study_hours", "attendance", "current_gpa",
                 "lms_activity"]
OUTLIER_COLUMNS = ["student_id", "student_name", "department", "current_gpa"]

# An entity is at risk when any of these columns is below its bound.
RISK_BOUNDS = {"current_gpa": 6.0, "attendance": 70.0, "final_exam": 45.0}
# Probability -> level; below the last bound -> LOW.
RISK_LEVELS = [(0.70, "HIGH"), (0.40, "MEDIUM")]
RISK_LEVEL_DEFAULT = "LOW"

# Indicators flagged when below these values.
INDICATOR_LIMITS = {"attendance_avg": 75.0, "internals_avg": 18.0, "study_hours": 8.0,
                    "assign_completion": 60.0}

SEGMENT_BEST, SEGMENT_WORST, SEGMENT_MIDDLE = "High Performer", "At Risk", "Consistent Performer"

ACTION_STATUSES = ("PENDING", "COMPLETED", "REJECTED", "RESOLVED")
# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class MeasureRule:
    """How one numeric measure is clipped and, where missing, filled."""

    column: str
    high: float
    fallback: float
    low: float = 0.0
    family: str = "marks"  # which audit counter its corrections go to


def score_rule(column: str) -> MeasureRule:
    """Rule of a discovered score column."""
    return MeasureRule(column, 100.0, 0.0)


# Limits, fallbacks and counter family per measure.
ACADEMIC_RULES = [
    MeasureRule("attendance", 100.0, 85.0, family="attendance"),
    MeasureRule("internal_1", 30.0, 0.0),
    MeasureRule("internal_2", 30.0, 0.0),
    MeasureRule("assignment_score", 100.0, 0.0),
    MeasureRule("quiz_score", 100.0, 0.0),
    MeasureRule("final_exam", 100.0, 0.0),
    MeasureRule("previous_gpa", 10.0, 7.0, family="attendance"),
    MeasureRule("study_hours", 30.0, 10.0, family="attendance"),
    MeasureRule("lms_activity", 500.0, 10.0, family="attendance"),
    MeasureRule("assignment_completion", 100.0, 10.0, family="attendance"),
]

# Range rules of the quality report.
ACADEMIC_RANGES = {
    "attendance": [MeasureRule("attendance", 100.0, 0.0, family="attendance")],
    "marks": [MeasureRule("internal_1", 30.0, 0.0), MeasureRule("internal_2", 30.0, 0.0),
              MeasureRule("assignment_score", 100.0, 0.0), MeasureRule("quiz_score", 100.0, 0.0),
              MeasureRule("final_exam", 100.0, 0.0)],
}


@dataclass(frozen=True)
class Roles:
    """Which column plays which part in a report."""

    entity: str = "student_id"
    name: str = "student_name"
    group: str = "department"
    item: str = "subject"
    score: str = "current_gpa"
    attendance: str = "attendance"
    index: str = "performance_index"
    exam: str = "final_exam"
    trend: str = "performance_trend"
    order: list[str] = field(default_factory=list)

    def entity_in(self, columns: list[str]) -> str | None:
        """Entity column, else the name column, else none."""
        return next((c for c in (self.entity, self.name) if c in columns), None)
