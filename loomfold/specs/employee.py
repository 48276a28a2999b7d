"""The employee-master contract: field list, vocabularies and alias words.

Fixed values, stated as data.  "Also called ..." in a description lists the
other names a source may use for the field; column matching reads them there.
"""

from __future__ import annotations

from loomfold.spec import SchemaSpec

GENDER_WORDS = {
    "m": "Male", "male": "Male", "man": "Male",
    "f": "Female", "female": "Female", "woman": "Female",
    "o": "Other", "other": "Other", "non-binary": "Other",
    "u": "Undisclosed", "na": "Undisclosed", "n/a": "Undisclosed",
    "not disclosed": "Undisclosed", "prefer not to say": "Undisclosed",
}
EMPLOYMENT_WORDS = {
    "fte": "Permanent", "full time": "Permanent", "full-time": "Permanent",
    "permanent": "Permanent", "perm": "Permanent", "regular": "Permanent",
    "contractor": "Contract", "contract": "Contract", "temp": "Contract",
    "temporary": "Contract", "fixed term": "Contract",
    "intern": "Intern", "internship": "Intern", "trainee": "Intern",
    "consultant": "Consultant", "advisor": "Consultant",
}
STATUS_WORDS = {
    "a": "Active", "active": "Active", "current": "Active", "working": "Active",
    "y": "Active", "yes": "Active", "employed": "Active",
    "i": "Inactive", "inactive": "Inactive", "left": "Inactive",
    "exited": "Inactive", "resigned": "Inactive", "terminated": "Inactive",
    "n": "Inactive", "no": "Inactive", "separated": "Inactive",
}

EMPLOYEE = SchemaSpec.from_dict({
    "entity": "employee",
    "version": 1,
    "record_identifiers": ["employee_code", "work_email"],
    "person_identifier": "pan",
    "fields": [
        {"name": "employee_code", "required": True, "unique": True, "identity": "strong", "max_length": 20,
         "description": "Number or code the employer gave this employment record. Also called employee id, "
                        "employee number, emp id, emp code, emp no, staff number, personnel number, associate id."},
        {"name": "first_name", "required": True,
         "description": "Given part of the name, without the surname. Also called given name, forename, fname."},
        {"name": "last_name", "required": True,
         "description": "Family part of the name. Also called surname, family name, lname."},
        {"name": "work_email", "format": "email", "required": True, "unique": True, "identity": "strong",
         "description": "Address the company issued for work. Also called office email, corporate email, "
                        "business email, official mail id."},
        {"name": "personal_email", "format": "email",
         "description": "Private address outside the company. Also called personal mail, private email, "
                        "alternate email."},
        {"name": "phone", "format": "phone",
         "description": "Telephone number to reach the employee. Also called mobile, mobile number, cell number, "
                        "contact number, telephone."},
        {"name": "date_of_birth", "type": "date", "required": True,
         "description": "Day the employee was born. Also called DOB or birth date."},
        {"name": "date_of_joining", "type": "date", "required": True,
         "description": "First day of employment. Also called joining date, hire date, date of hire, start date, DOJ."},
        {"name": "date_of_exit", "type": "date",
         "description": "Final day of employment, if any. Also called last working day, exit date, "
                        "termination date, relieving date."},
        {"name": "department", "type": "enum", "required": True,
         "description": "Part of the organisation the employee works in. Also called function, division, business unit.",
         "enum": ["Engineering", "Sales", "Marketing", "Human Resources", "Finance", "Operations",
                  "Customer Success", "Legal"]},
        {"name": "designation", "required": True,
         "description": "What the employee does. Also called title, job title, position, role."},
        {"name": "employment_type", "type": "enum", "required": True, "default": "Permanent",
         "description": "Kind of contract. Also called employee type, worker type, engagement type.",
         "enum": ["Permanent", "Contract", "Intern", "Consultant"], "aliases": EMPLOYMENT_WORDS},
        {"name": "grade",
         "description": "Pay or seniority step. Also called band, level, pay grade, job level, grade band."},
        {"name": "location",
         "description": "Place of work. Also called work location, base location, office, city."},
        {"name": "gender", "type": "enum",
         "description": "Gender on record. Also called sex.",
         "enum": ["Male", "Female", "Other", "Undisclosed"], "aliases": GENDER_WORDS},
        {"name": "manager_email", "format": "email", "references": "work_email",
         "description": "Work address of the direct manager. Also called reporting manager, supervisor, "
                        "line manager, reports to."},
        {"name": "pan", "format": "pan", "pii": True, "identity": "strong",
         "description": "Ten-character income tax number of the person. Also called PAN number, PAN card, "
                        "income tax number."},
        {"name": "uan", "format": "uan", "pii": True,
         "description": "Twelve-digit provident fund number. Also called UAN number, PF number, provident fund number."},
        {"name": "bank_account", "format": "bank_account", "pii": True,
         "description": "Account the salary is paid to. Also called account number, salary account, bank ac."},
        {"name": "ifsc", "format": "ifsc",
         "description": "Code of the bank branch. Also called IFSC code, branch code."},
        {"name": "status", "type": "enum", "required": True, "default": "Active",
         "description": "Whether the employee still works here. Also called employment status, active flag, "
                        "current status.",
         "enum": ["Active", "Inactive"], "aliases": STATUS_WORDS},
    ],
})
